def words(seed, n):
    import random

    r = random.Random(seed)
    return " ".join("".join(r.choice(["an", "er", "th", "on", "ti", "sh", "ou", "re"]) for _ in range(r.randint(1, 4))) for _ in range(n))
