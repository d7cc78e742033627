"""Relations and what can be asked of them."""
