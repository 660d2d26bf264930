"""Plain restatements of what the operators compute, for small inputs."""

from functools import lru_cache

LETTERS, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "1234567890"
UP, DOWN = LETTERS, LETTERS[::-1]

EXAMPLE_LINES = [
    DIGITS * 3, (UP * 2).lower(), DOWN * 2, DIGITS[::-1] * 3, ("XYZ" + UP + UP[:-3]).lower()
]
EXAMPLE2_LINES = [DIGITS * 3 + (UP * 2).lower(), DOWN * 2, DIGITS[::-1] * 3]
QUERY2_LINES = [
    "UTSRQPONMLKJIHGFEDCBA0987654321098765432109",
    "AAAAAAAAAAAAAHGFEDCBA0987654321098765432109",
    "BBBBBBBBMLKJIHGFEDCBA0987654321098765432109",
    "1221231212211212121212122121211212121212212",
    "2" * 32,
    "3" * 28,
]
QUERY_SET = [
    (1, "jklmnopqrstuvwxyz"),
    (2, "1234567890abcdefghijklmnopqrstuvwxyz"),
    (3, "90abcdfffghisajklmnopqrst"),
    (4, "765432109876543210987654321"),
]


def kmers(text, k):
    return [(i, text[i:i + k]) for i in range(len(text) - k + 1) if text[i:i + k] != "N" * k]


def diagonals(query, ref, k):
    hits = {}
    for i, a in kmers(query, k):
        for j, b in kmers(ref, k):
            if a == b:
                end = j + len(query) - 1 - i
                hits[end] = hits.get(end, 0) + 1
    return hits


def slow_align(ref, query):
    """Alignment by definition, cell by cell."""
    if not ref or not query:
        return None

    @lru_cache(maxsize=None)
    def value(i, j):
        if i == 0 or j == 0:
            return -3 * max(i, j)
        same = 2 if ref[i] == query[j] else -1
        return max(value(i - 1, j - 1) + same, value(i, j - 1) - 3, value(i - 1, j) - 3)

    i, j = len(ref) - 1, len(query) - 1
    for a in range(len(ref)):
        for b in range(len(query)):
            value(a, b)
    pairs = [(ref[i], query[j])]
    while i and j:
        options = [(value(i - 1, j - 1), 2), (value(i, j - 1), 1), (value(i - 1, j), 0)]
        way = max(options)[1]
        i, j = i - (way != 1), j - (way != 0)
        pairs.append(("-" if way == 1 else ref[i], "-" if way == 0 else query[j]))
    pairs.reverse()
    score = sum(a == b for a, b in pairs) / len(pairs)
    return score, "".join(a for a, _ in pairs), "".join(b for _, b in pairs)
