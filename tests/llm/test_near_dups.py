import random

from caseloom.llm.near_dups import chunks, largest_distance, near_duplicates, shingle_set


def brute(rows, width, percent):
    sets = {}
    for k, t in rows:
        words = (t or "").encode().lower().split()
        span = min(width, len(words))
        sets[k] = {tuple(words[i : i + span]) for i in range(len(words) - span + 1)} if words else set()
    root = {k: k for k in sets}

    def find(k):
        return k if root[k] == k else find(root[k])

    for a in sets:
        for b in sets:
            shared = len(sets[a] & sets[b])
            if a < b and shared and 100 * shared >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: (len(sets[k]), find(k)) for k in sets}


def test_against_brute_force(frame):
    chance, rows = random.Random(5), []
    words = [f"w{k}" for k in range(400)]
    for _ in range(25):
        base = [chance.choice(words) for _ in range(chance.randint(1, 150))]
        rows.append(base)
        for _ in range(chance.choice([0, 1, 6])):
            copy = list(base)
            for _ in range(chance.choice([0, 1, 2, 4, 8])):
                copy[chance.randrange(len(copy))] = chance.choice(words)
            rows.append(copy)
    texts = [(k * 3, "\n".join(r)) for k, r in enumerate(rows)] + [(9001, ""), (9002, None), (9003, " \t"), (9004, "É x"), (9005, "é x")]
    for width, percent in ((3, 85), (5, 80)):
        got = near_duplicates(frame(texts), width, percent).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(texts, width, percent)
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_many_copies_in_a_bucket(frame):
    """A chain of near copies, in which most pairs are no links, is still one group."""
    chance = random.Random(6)
    words = [chance.choice("abcdefgh") * chance.randint(1, 9) + str(chance.randint(0, 99)) for _ in range(120)]
    rows = []
    for k in range(60):
        words[(k * 7) % 120] = f"new{k}"
        rows.append((k, " ".join(words)))
    got = near_duplicates(frame(rows), 3, 85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, 3, 85)


def test_odd_rows(frame):
    rows = [(None, "a b c"), (1, "a b c"), (1, "a b c"), (2, "A  b\tc"), (3, None)]
    got = sorted((str(r.doc_id), str(r.component_id), r.kept) for r in near_duplicates(frame(rows), 3, 85).collect())
    assert got == [("1", "1", True), ("1", "1", True), ("2", "1", False), ("3", "3", True), ("None", "None", True)]
    assert near_duplicates(frame([]), 3, 85).count() == 0


def test_pigeonhole():
    distance = largest_distance(0.85)
    assert all(2 * len(chunks(64, d)) > d for d in range(64))
    assert 9 < distance < 40
    assert len(shingle_set(b"a b", 3)) == 1 and not len(shingle_set(b" ", 3))
