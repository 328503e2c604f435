"""The prefix trie beside a plain Python version."""

import hashlib
import random
import re
import zlib

import pytest

from caseloom.llm import prefix_trie as module
from caseloom.llm.prefix_trie import count_min, ends_digests, prefix_trie, prefixes, rebuilt, turn_rows, with_ends

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain_sequences(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own.setdefault(c, []).append(((turn is not None, turn or 0, digest), (role, text)))
    own = {c: [t for _, t in sorted(turns)] for c, turns in own.items()}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        made[c] = own.get(base, [])[:h] + turns[h:]
    return made


def plain_trie(rows):
    made = plain_sequences(rows)
    members = {}
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    result = []
    for node, cs in members.items():
        below = [n for n in members if n[: len(node)] == node]
        children = [n for n in below if len(n) == len(node) + 1]
        leaves = [n for n in below if not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in below)]
        words = lambda n: len(re.findall("[^\x20\x09-\x0d]+", n[-1][1])) if n else 0
        saved = sum((len(members[n]) - 1) * words(n) for n in below)
        ends = ",".join(map(str, sorted(c for c in cs if len(made[c]) == len(node))))
        parent = min(members[node[:-1]]) if node else None
        result.append((min(cs), len(node), parent, len(cs), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(result, key=repr)


def found(df):
    trie = with_ends(prefix_trie(*rebuilt(turn_rows(df))))
    return sorted((tuple(r) for r in trie.select(*COLUMNS).collect()), key=repr)


@pytest.fixture
def rows():
    pick, made = random.Random(7), []
    texts = ["hi there", "", None, "one two three", "x", "long " * 40]
    for c in [*range(-45, 85, 3), *range(200, 205), 10**12, 10**12 + 7]:
        for turn in range(pick.choice([1, 1, 2, 3, 5, 8])):
            made.append((c, turn, pick.choice(["user", "assistant", None]), pick.choice(texts[: 2 + turn % 5])))
    # Equal conversations, repeated and null turns, rows without an id.
    made += [(c, t, "user", f"same {t}") for c in range(300, 340) for t in range(6)]
    made += [(400, None, "system", "first"), (400, 0, "user", "b"), (400, 0, "user", "a"), (400, 0, "user", "a"), (None, 0, "user", "lost")]
    pick.shuffle(made)
    return made


def test_same_as_plain_version(frame, rows):
    assert found(frame(rows, SCHEMA)) == plain_trie(rows)


def test_full_sketch_and_small_blocks(frame, rows, monkeypatch):
    """Also right if the sketch proves nothing, and if conversations are cut into many blocks."""
    monkeypatch.setattr(module, "BLOCK_TURNS", 2)
    monkeypatch.setattr(module, "CHUNK_IDS", 3)
    monkeypatch.setattr(module, "MAX_LOG_CELLS", 3)
    assert found(frame(rows, SCHEMA)) == plain_trie(rows)


def test_hot_conversation(frame, monkeypatch):
    """A conversation with most of the rows, and its copy up to a late turn."""
    monkeypatch.setattr(module, "BLOCK_TURNS", 16)
    long = [(0, t, "user", f"turn {t}") for t in range(100)]
    rows = long + [(20, t, "user", f"turn {t}" if t != 70 else "other") for t in range(100)] + [(41, 0, "user", "short")]
    assert found(frame(rows, SCHEMA)) == plain_trie(rows)


def test_conversations_left_without_turns(frame):
    rows = [(c, 0, "user", "only") for c in (21, 22, 23, 24, 25, 26, 27)]
    assert any(not turns for turns in plain_sequences(rows).values())
    assert found(frame(rows, SCHEMA)) == plain_trie(rows)


def test_empty_table(frame):
    assert found(frame([], SCHEMA)) == []
    assert found(frame([(None, 1, "user", "x")], SCHEMA)) == []


def test_clashing_columns(spark, rows):
    from pyspark.sql import functions as F

    names = ["depth", "position", "digest", "words", "n_turns", "_a", "_b", "_part", "_seq", "_block", "_head", "_last"]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("other") for c in names})
    assert found(df) == plain_trie(rows)


def test_estimates_are_never_too_low(frame, rows):
    tested = prefixes(rebuilt(turn_rows(frame(rows, SCHEMA)))[0])
    sketch, log_cells = count_min(tested, tested.count())
    table = tested.select("_a", "_b").toArrow()
    import numpy as np
    from collections import Counter

    a, b = table.column("_a").to_numpy(), table.column("_b").to_numpy()
    estimate = np.min([sketch[own] for own in module.cells(a, b, log_cells)], axis=0)
    exact = Counter(zip(a.tolist(), b.tolist()))
    assert all(e >= min(exact[k], 255) for k, e in zip(zip(a.tolist(), b.tolist()), estimate.tolist()))


def test_digest_of_many_ends(spark, monkeypatch):
    monkeypatch.setattr(module, "CHUNK_IDS", 10)
    ids = {(1, 2): list(range(0, 2000, 3)), (1, 3): [-5, 7], (4, 0): [9]}
    rows = [(*k, c) for k, cs in ids.items() for c in cs]
    random.Random(1).shuffle(rows)
    got = ends_digests(spark.createDataFrame(rows, "_a bigint, _b bigint, conv_id bigint").repartition(5)).collect()
    assert {(r[0], r[1]): r[2] for r in got} == {
        k: hashlib.sha256(",".join(map(str, sorted(cs))).encode()).hexdigest() for k, cs in ids.items()
    }
