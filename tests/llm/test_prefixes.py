import hashlib
import random
import zlib

from tests.llm.helpers import with_clashes
from vitaloom.llm import prefixes

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
COLUMNS = (
    "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
    "ends_sha256",
)


def digest(role, text):
    role, text = (role or "").encode(), (text or "").encode()
    return hashlib.sha256(str(len(role)).encode() + b":" + role + text).digest()[:16]


def brute(rows):
    """The nodes by lists of whole turns."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append(((turn is not None, turn or 0), digest(role, text), role or "", text or ""))
    own = {c: [x[2:] for x in sorted(turns)] for c, turns in own.items()}
    full = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        rest = abs(c) % 5 * (1 if c >= 0 else -1)
        full[c] = tuple(own.get(c - rest, [])[:h] + turns[h:])
    nodes = {}
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(turns[:d], []).append(c)
    out = []
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        size = lambda p: len(p[-1][1].encode()) if p else 0
        inner = {p[:-1] for p in below if p}
        ends = ",".join(str(c) for c in sorted(members) if full[c] == path)
        out.append(
            (
                min(members),
                len(path),
                min(nodes[path[:-1]]) if path else None,
                len(members),
                sum(len(p) == len(path) + 1 for p in below),
                sum(p not in inner for p in below),
                sum((len(nodes[p]) - 1) * size(p) for p in below),
                hashlib.sha256(ends.encode()).hexdigest(),
            )
        )
    return sorted(out, key=repr)


def found(spark, rows, extra=lambda df: df):
    df = prefixes.prefix_trie(extra(spark.createDataFrame(rows, SCHEMA).repartition(3)))
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def made(seed, n, ids=None):
    rng = random.Random(seed)
    rows = []
    for c in ids or range(n):
        for turn in range(rng.randrange(1, 12)):
            text = rng.choice(["hi", "hello", "ä", "", None, "x" * 50])
            rows.append((c, turn if rng.random() < 0.95 else None, rng.choice(["user", None]), text))
    return rows


def test_equals_brute_force(spark):
    rows = made(1, 120)
    assert found(spark, rows) == brute(rows)


def test_a_first_turn_that_most_conversations_share(spark):
    hot = [(c, t, "user", "same") for c in range(0, 400, 5) for t in range(3)]
    rows = hot + [r for r in made(2, 60) if r[0] % 5 or r[0] >= 400]
    assert found(spark, rows) == brute(rows)


def test_trie_of_small_shards_equals_one(monkeypatch):
    import pyarrow as pa

    rows = sorted((c - c % 5, c, (t or 0, digest(role, text)), len(text or "")) for c, t, role, text in made(3, 50))
    batch = pa.record_batch(
        [
            pa.array([r[0] for r in rows], pa.int64()),
            pa.array([r[1] for r in rows], pa.int64()),
            pa.array([r[2][1] for r in rows], pa.binary()),
            pa.array([r[3] for r in rows], pa.int64()),
        ],
        names=["base", "conv_id", "digest", "n_bytes"],
    )

    def totals(limit):
        monkeypatch.setattr(prefixes, "SHARD_CONVERSATIONS", limit)
        sums = {}
        shards = set()
        for part in prefixes._shards(iter([batch])):
            for r in part.to_pylist():
                shards.add(r["shard"])
                kept = sums.setdefault(r["node"], [0, 0, []])
                kept[0] += r["n_convs"]
                kept[1] += r["n_ends"]
                kept[2] += filter(None, r["ends"].split(","))
        return sums, len(shards)

    one, n_one = totals(4096)
    many, n_many = totals(3)
    assert one == many and n_one == 1 and n_many > 5


def test_hard_rows(spark):
    rows = [
        (None, 0, "user", "nobody"),
        (0, None, None, None),
        (0, 1, "user", "a"),
        (0, 1, "user", "a"),  # a repeated row is a turn of its own
        (1, 0, "user", "b" * 300_000),
        (7, 3, "user", "alone"),  # no conversation 5: turnless where it shares all its turns
        (-3, 0, "user", "below nought"),
        (-5, 0, "user", "below nought"),
        (10**15, 0, "ab", "c"),
        (10**15 + 1, 0, "a", "bc"),
    ]
    assert found(spark, rows, with_clashes) == brute(rows)


def test_long_conversation_and_empty_table(spark):
    rows = [(0, t, "user", f"t{t % 7}") for t in range(3000)] + [(1, t, "user", "x") for t in range(20)]
    got = found(spark, rows)
    assert len(got) == len({r[:2] for r in got}) and max(r[1] for r in got) == 3000
    assert [r for r in got if r[1] == 0][0][3] == 2
    assert found(spark, [(None, 1, "user", "x")]) == []
    assert prefixes.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
