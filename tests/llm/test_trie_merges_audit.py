"""The prefix trie, tree concatenation and the source audit against brute force, on rows with every odd case."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from topicflow.llm import divergence, prefix_trie, queries
from topicflow.llm import tree_concatenation as tree

rng = np.random.default_rng(11)


# --- prefix trie -------------------------------------------------------------

TURNS = "conv_id long, turn int, role string, text string, path string, sizes int, start int, shard long, kind string"


def conversations() -> list[tuple]:
    opening = [("user", "Hello"), ("assistant", "Hi, é?"), ("user", None), (None, "x" * 3000), ("user", "")]
    rows = []
    for c in range(120):
        if c in (10, 15, 41, 42, 77):
            continue  # absent, also as the one that others begin with
        turns = opening[: c % 6] if c % 3 else [("user", "Hello"), ("assistant", "Hi, é?"), ("user", f"q{c % 4}")]
        turns = turns + [("user", f"own {c % 7}")] * (c % 4)
        rows += [(c, None if k == 0 and c % 5 == 1 else k, r, t) for k, (r, t) in enumerate(turns)]
    rows += [(c, k, "u", f"same {k}") for c in range(200, 260) for k in range(9)]  # copies of one conversation
    rows += [(300, k // 2, "u", f"tie {k % 2}") for k in range(12)] + [(301, 3, "u", "twice")] * 4
    rows += [(c, k, "u", f"deep {k}") for c in (400, 405, 410) for k in range(700)]
    rows += [(None, 0, "user", "of no one"), (-7, 0, "user", "Hello"), (-3, 1, None, None), (10**12, 0, "user", "Hello")]
    return [r + (["p", 1, 2, 3, "k"][0], 1, 2, 3, "k") for r in rows]


def brute_trie(rows) -> set[tuple]:
    def key(role, text):
        return hashlib.md5(f"{len(role or '')}:{role or ''}:{text or ''}".encode()).digest()

    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, key(role, text), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(np.fmod(c, 5))
        built[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c, path in built.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, cs in members.items():
        worth = (len(cs) - 1) * len(p[-1][1].encode()) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += worth
    return sorted(
        (min(cs), len(p), min(members[p[:-1]]) if p else -1, len(cs), children[p], leaves[p], saved[p], hashlib.sha256(",".join(str(c) for c in sorted(cs) if len(built[c]) == len(p)).encode()).hexdigest())
        for p, cs in members.items()
    )


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize("shards", [1, 3, 40])
def test_trie(spark, monkeypatch, shards):
    rows = conversations()
    df = spark.createDataFrame(rows, TURNS).repartition(5)
    monkeypatch.setattr(prefix_trie, "ENDS_BLOB", 40)
    found = prefix_trie.conversation_trie(df, shards)
    assert found.columns == NODE
    got = [tuple(-1 if v is None else v for v in r) for r in found.collect()]
    assert sorted(got) == brute_trie(rows)


def test_trie_of_nothing_and_of_turnless_conversations(spark):
    turns = spark.createDataFrame([(c, 0, "u", "a") for c in (2, 3)], "conv_id long, turn long, role string, text string")
    assert prefix_trie.conversation_trie(turns.filter("false")).collect() == []
    got = [tuple(r) for r in prefix_trie.conversation_trie(turns).collect()]  # 0 is absent, and both take a turn or more from it
    assert got == [(2, 0, None, 2, 0, 1, 0, hashlib.sha256(b"2,3").hexdigest())]


def test_shared_nodes_only_are_put_together(spark):
    """All but the nodes on borders are finished in their shard."""
    rows = [(c, k, "u", f"{c % 50} {k}") for c in range(500) for k in range(4)]
    paths = prefix_trie.turn_paths(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    sorted_rows = sorted((r.path, r.conv_id, r.sizes) for r in paths.collect())
    cut = [sorted_rows[:255], sorted_rows[255:]]
    depth = prefix_trie.common_depth(bytes(cut[0][-1][0]), bytes(cut[1][0][0]))
    given_rows = [(0, None, bytes(cut[0][-1][0])[: 16 * depth], [])] + [(s, c, bytes(p), z) for s in (0, 1) for p, c, z in cut[s]]
    kinds = Counter(r[0] for r in prefix_trie.shard_nodes(iter(given_rows), [(-1, 0), (depth, 0)]))
    assert depth == 4 and kinds["part"] == 2 * 5 and kinds["ends"] == 2 and kinds["node"] + kinds["child"] == 49 * 4


# --- tree concatenation ------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tree.default_vocabulary())


@pytest.fixture(scope="module")
def own():
    return tree.encoder(tree.default_vocabulary())


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("abzAZéÉßİª.,!?;: '’1²½\t\n\x1c\x85　Σςé中한ﬁ😀<|"), max_size=30))
def test_chunks_are_encoded_as_whole_texts(text):
    encoder, whole = tree.encoder(tree.default_vocabulary()), Tokenizer.from_file(tree.default_vocabulary()) if not _WHOLE else _WHOLE[0]
    _WHOLE[:] = [whole]
    want = whole.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(encoder.encode([text.encode()])[0], "<u4").tolist() == want
    assert encoder.decode(np.array(want, "<u4")) == whole.decode(want, skip_special_tokens=False)


_WHOLE: list = []


@settings(max_examples=60, deadline=None)
@given(st.sampled_from(["ab", "a", "aethino", "abcdefghijklmnopqrstuvwxyz", "!?.-", "éß", "中文字", "hahe"]), st.integers(2, 900), st.integers(1, 5), st.integers(0, 2**32))
def test_parts_join_to_the_encoding_of_the_whole(alphabet, n, log_parts, seed):
    encoder = tree.encoder(tree.default_vocabulary())
    symbols = encoder._bytes("".join(np.random.default_rng(seed).choice(list(alphabet), n)))
    parts = 1 << min(log_parts, n.bit_length() - 1)
    cut = [symbols[p * len(symbols) // parts : (p + 1) * len(symbols) // parts] for p in range(parts)]
    for ends in (True, False):
        ids = encoder.concatenated([encoder.merged(c, ends and p + 1 == parts) for p, c in enumerate(cut)], ends)
        assert ids.tolist() == encoder.merged(symbols, ends).tolist()


def test_a_window_grows_until_both_sides_agree(own):
    """Tokens of equal letters shift along the whole run when its parity changes."""
    left, right = own.merged("a" * 1001, False), own.merged("a" * 777, True)
    assert own.joined(left, right, True).tolist() == own.merged("a" * 1778, True).tolist()


def documents() -> list[tuple]:
    long = "".join(rng.choice(list("abcdefgh"), 9000))
    texts = [None, "", " \t\n", "Hello, World's  end.", "É́ \x1c x　y", "<|endoftext|> a<|startoftext|>b", "Same", "Same"]
    texts += [long, f"before {long}é{long[:5000]} 12{'!' * 6000}<|endoftext|>{long[:4500]}'s after", "a" * 20_000 + " tail", "中" * 5000 + "，" + "文" * 4100]
    texts += [" ".join("".join(rng.choice(list("aeiounst"), rng.integers(1, 9))) for _ in range(30_000)), "x" * 4096, "x" * 4095]
    return [(None if k == 7 else 6 if k == 5 else k, t, "en", 1, 2, b"i", "r") for k, t in enumerate(texts)]


DOCUMENTS = "doc_id long, text string, lang string, row int, place int, ids binary, symbols string"


@pytest.mark.parametrize("fan_in", [2, 16])
def test_texts_are_encoded_and_decoded_as_by_the_library(spark, library, monkeypatch, fan_in):
    monkeypatch.setattr(tree, "FAN_IN", fan_in)
    rows = documents()
    got = tree.decode(tree.encode(spark.createDataFrame(rows, DOCUMENTS).repartition(3))).collect()
    want = []
    for d, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((-1 if d is None else d, np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False)))
    assert sorted((-1 if r.doc_id is None else r.doc_id, bytes(r.ids), r.text) for r in got) == sorted(want)


def test_encoding_of_nothing(spark):
    none = spark.createDataFrame([], DOCUMENTS)
    assert tree.decode(tree.encode(none)).collect() == []


def test_other_kinds_of_vocabulary_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError):
        tree.WordEncoder(public_tokenizers.path("byte_bpe_50k.json"))


def test_encoding_query(spark, library):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op12_tree_concatenation(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = library.encode(docs[r.doc_id] or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


# --- source audit ------------------------------------------------------------

TEXTS = "doc_id long, text string, lang string, source string, n long, term string, value int, item string, rank int"


def audited() -> list[tuple]:
    words = ["Alpha", "alpha", "beta", "Été", "été", "naïve", "x", "3d", "a_b", "don't", "ΣΣ", "中文", "\x80", "zzz", "\x00q"]
    rows = []
    for k in range(90):
        lang = ["en", "de", None, ""][k % 4] if k < 80 else "solo"
        source = [None, "a", "b", "", "c"][k % 5] if k < 80 else "only"
        weights = np.arange(1, len(words) + 1) ** (1.0 if k % 5 == 1 else 0.2)
        text = " ".join(rng.choice(words, rng.integers(0, 40), p=weights / weights.sum()))
        rows.append((k % 70, text, lang, source))
    rows += [(1, None, "en", "quiet"), (2, "12 34", "en", "blank"), (3, "Alpha " * 4000, "en", "a"), (4, "u1 v2", "rare", "a"), (5, "w", "rare", "b"), (None, "alpha", "en", "a")]
    return [r + (1, "t", 2, "i", 3) for r in rows]


def brute_audit(rows, top) -> list[tuple]:
    docs = [(r[2] or "", r[3] or "", [t.translate({c: c + 32 for c in range(65, 91)}) for t in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", r[1] or "")]) for r in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for d in own for t in set(d[2]))
        kept = sorted(t for t, n in df.items() if n >= 3)
        counts = {s: Counter(t for d in own if d[1] == s for t in d[2] if t in set(kept)) for s in {d[1] for d in own}}
        whole = sum(counts.values(), Counter())

        def share(c, t):
            return 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept))

        def excess(p, q):
            return (p - q) ** 2 // q

        for s, c in counts.items():
            pairs = [(sum(excess(share(c, t), share(o, t)) for t in kept), i) for i, o in counts.items() if i != s]
            terms = [(excess(share(c, t), share(whole, t)), t) for t in kept if c[t] and share(c, t) > share(whole, t)]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                ordered = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, i, v, k) for k, (v, i) in enumerate(ordered[:most], 1)]
    return sorted(out)


@pytest.mark.parametrize("top, bucket_terms", [(200, 4096), (3, 2)])
def test_audit(spark, monkeypatch, top, bucket_terms):
    monkeypatch.setattr(divergence, "HELD_TERMS", 5)
    monkeypatch.setattr(divergence, "_SLICE", 100)
    rows = audited()
    found = divergence.audit(spark.createDataFrame(rows, TEXTS).repartition(4), top=top, bucket_terms=bucket_terms)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in found.collect()) == brute_audit(rows, top)


def test_audit_of_nothing(spark):
    assert divergence.audit(spark.createDataFrame([], TEXTS)).collect() == []


def test_joint_cells_in_blocks(monkeypatch):
    """The sums do not depend on how many rows are compared at once."""
    source = np.repeat(np.arange(6), [3, 1, 5, 2, 4, 3])
    p, zero = rng.integers(2, 10**9, len(source)), np.array([5, 7, 11, 13, 17, 19])[source]
    bits = rng.integers(0, 1 << 63, len(source), dtype=np.uint64)
    whole = divergence.joint_sums(source, p, zero, bits)[1]
    monkeypatch.setattr(divergence, "_CELLS", 1)
    assert (divergence.joint_sums(source, p, zero, bits)[1] == whole).all()


def test_shares_of_huge_counts_are_exact(spark):
    n, total = 9 * 10**15, 4 * 10**17 + 1
    row = spark.range(1).select(divergence._share(f"{n}L", f"{total}L", "3L").alias("p")).first()
    assert row.p == 1 + 10**9 * (n + 1) // (total + 3)
    assert spark.range(1).select(divergence._excess("1000000001L", "1L").alias("f")).first().f == 10**18
