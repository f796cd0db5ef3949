"""Texts for the tests."""

LETTERS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed: int, n: int) -> str:
    """n words, repeatable, unlike those of other seeds."""
    out, x = [], seed * 7919 + 1
    for _ in range(n):
        x = (x * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        out.append(LETTERS[(x >> 33) % 24] + LETTERS[(x >> 40) % 24][:3])
    return " ".join(out)
