"""The same conditions and rules over files that keep arriving."""
