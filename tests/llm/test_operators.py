"""Each operator against a brute-force version of itself, on rows with every odd case."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import AddedToken, Tokenizer

from topicflow.llm import (
    block_naming,
    common,
    host_reputation,
    hyperminhash,
    language_id,
    line_dedup,
    packing,
    phrase_automata,
    queries,
    raking,
    simple8b,
    tokens,
    vp_tree,
)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, root string, pos int, name string, band int"
rng = np.random.default_rng(3)
VOCABULARY = ["th", "er", "on", "an", "re", "ing", "nd", "ti", "ble", "sh", "of", "É", "ß"]


def prose(n: int) -> list[str]:
    return ["".join(rng.choice(VOCABULARY, rng.integers(1, 5))) for _ in range(n)]


def changed(words: list[str], share: float) -> list[str]:
    return [w if rng.random() > share else "new" + str(rng.integers(1000)) for w in words]


def corpus() -> list[tuple[int | None, str | None]]:
    base, passage = prose(160), prose(70)
    texts = [" ".join(changed(base, s)) for s in (0, 0.02, 0.04, 0.06, 0.08, 0.1, 0.12, 0.15, 0.2) for _ in range(3)]
    texts += [" ".join(prose(20) + passage[: 49 + k] + prose(15)) for k in range(6)] + [" ".join(passage)]
    texts += ["a line that recurs in document after document with few changes but one, which is its number among all of the lines: %d\n\n  \nand %s" % (k, " ".join(prose(9))) for k in range(12)]
    texts += ["", " \t\n ", "one", "One", "\u3000", "é\x85 \x1c b", "<|endoftext|>", "x" * 20_000, " ".join(prose(3000)), "Same.", "Same.", "same."]
    rows: list[tuple[int | None, str | None]] = [(3 * k % 101 if k < 60 else 200 + k, t) for k, t in enumerate(texts)]
    return rows + [rows[2], rows[2], rows[-3], (777, None), (778, None), (None, texts[0]), (None, None)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    data = [(d, t, None if (d or 0) % 7 == 0 else ("de" if t and "ß" in t else "en"), f"src{(d or 0) % 3}" if d else None, 0, 1, "r", 2, "n", 3) for d, t in rows]
    return spark.createDataFrame(data, SCHEMA)


@pytest.fixture(scope="module")
def none(docs):
    return docs.filter("false")


def joined(pairs, ids):
    parent = {i: i for i in ids}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components(spark):
    pairs = [(k, k + 1) for k in range(30)] + [(100, 200), (300, 200), (200, 100), (7, 7)]
    got = {r.id: r.root for r in common.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(1, 31)}, 200: 100, 300: 100}


def test_bitmap_never_loses_a_key(spark):
    keys, df = spark.range(0, 5000, 7).toDF("k"), spark.range(5000).toDF("k")
    hit, miss = common.split_by_bitmap(df, "k", common.bitmap(keys, "k"))
    assert hit.count() + miss.count() == 5000 and keys.join(miss, "k").count() == 0 and hit.count() < 800


def sets_of(rows, size):
    found: dict[int, list[frozenset]] = {}
    for d, t in rows:
        w = common.words(t, fold=True)
        found.setdefault(d, []).append(frozenset(zip(*(w[k:] for k in range(size)))) if len(w) >= size else frozenset([tuple(w)]) if w else frozenset())
    return found


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(docs, rows, size):
    got = hyperminhash.near_duplicates(docs, size=size).collect()
    sets = {d: s[0] for d, s in sets_of(rows, size).items() if d is not None}
    ids = sorted(sets)
    pairs = [(a, b) for a in ids for b in ids if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = joined(pairs, ids)
    assert len(got) == len(rows)
    for r in got:
        assert (r.component_id, r.kept) == ((want[r.doc_id], want[r.doc_id] == r.doc_id) if r.doc_id is not None else (None, True))
        assert r.doc_id is None or r.n_shingles == len(sets[r.doc_id])


def test_near_duplicates_of_nothing(none):
    assert hyperminhash.near_duplicates(none).collect() == []


def test_registers_estimate_with_collisions_corrected():
    a = np.unique(rng.integers(0, 1 << 63, 3000).astype(np.uint64))
    b = np.concatenate([a[:2400], np.unique(rng.integers(0, 1 << 63, 600).astype(np.uint64))])
    x, y = hyperminhash.registers(a)[None], hyperminhash.registers(b)[None]
    assert abs(hyperminhash.estimate(x, y, np.array([len(a)]), np.array([len(b)]))[0] - 2400 / 3600) < 0.15
    assert hyperminhash.compress(np.array([0, 1, 1 << 31, 0xFFFFFFFF], np.uint32)).tolist() == [32 << 10, 31 << 10, 0, 1023]
    assert 0 < hyperminhash.expected_collisions(1000, 1000) < 0.01


def test_exact_duplicates(docs, rows):
    got = block_naming.exact_duplicates(docs, block_bytes=64).collect()
    groups: dict[str, list] = {}
    for d, t in rows:
        groups.setdefault(t or "", []).append(d)
    keep = {t: max((d for d in ids if d is not None), default=None) for t, ids in groups.items()}
    want = sorted((str(d), str(keep[t or ""]), len(groups[t or ""]), d == keep[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for d, t in rows)
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in got) == want


def test_exact_duplicates_of_nothing(none):
    assert block_naming.exact_duplicates(none).collect() == []


def test_repeated_passages(docs, rows):
    first: dict[tuple, int] = {}
    for d, t in sorted(((d, t) for d, t in rows if d is not None), key=lambda r: r[0]):
        w = common.words(t)
        for s in range(len(w) - 49):
            first.setdefault(tuple(w[s : s + 50]), d)
    got = {r.doc_id: r for r in phrase_automata.remove_repeats(docs).collect()}
    removed = 0
    for d, t in rows:
        w = common.words(t)
        stays = [True] * len(w)
        for s in range(len(w) - 49 if d is not None else 0):
            if first[tuple(w[s : s + 50])] < d:
                stays[s : s + 50] = [False] * 50
        kept = b" ".join(x for x, y in zip(w, stays) if y).decode()
        assert (got[d].n_words, got[d].n_removed) == (len(w), len(w) - sum(stays)) or d is None
        assert got[d].kept == kept or d is None
        removed += len(w) - sum(stays)
    assert removed > 500


def test_repeated_passages_of_nothing(none):
    assert phrase_automata.remove_repeats(none).collect() == []


def test_sketches_never_differ_in_more_bits_than_their_sets():
    for size in (0, 1, 50, 900, 6000):
        a, b = (np.unique(rng.integers(0, 3 * size + 1, size).astype(np.uint64)) for _ in range(2))
        x, y = (common.odd_sketch(common.mix64(s), hyperminhash.SKETCH_LONGS).view(np.uint64) for s in (a, b))
        ones = int(np.bitwise_count(x ^ y).sum())
        assert ones <= len(np.setxor1d(a, b)) and (size != 50 or ones > 0.8 * len(np.setxor1d(a, b)))


def test_links_inside_a_group_that_stays_apart(spark):
    base = [f"word{k}" for k in range(220)]
    family = [[w if rng.random() > 0.055 else f"x{rng.integers(10**9)}" for w in base] for _ in range(40)]
    family += [changed(f, 0.03) for f in family[:25]]
    data = list(enumerate(" ".join(f) for f in family))
    sets = {d: s[0] for d, s in sets_of(data, 2).items()}
    pairs = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = joined(pairs, sets)
    assert 20 < len(set(want.values())) < 64
    got = hyperminhash.near_duplicates(spark.createDataFrame(data, "doc_id long, text string"), size=2).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_line_dedup(docs, rows):
    place: dict[str, tuple[int, int]] = {}
    for d, t in sorted(((d, t) for d, t in rows if d is not None), key=lambda r: r[0]):
        for k, line in enumerate((t or "").split("\n")):
            if line.strip(" \t\x0b\x0c\r"):
                place.setdefault(line, (d, k))
    lines = sorted(place, key=place.get)
    pairs = [(a, b) for a in range(len(lines)) for b in range(a + 1, len(lines)) if line_dedup.likeness(lines[a], lines[b]) >= 0.8]
    stays = {place[lines[a]] for a, root in joined(pairs, range(len(lines))).items() if a == root}
    got = {(r.doc_id, r.text) for r in line_dedup.dedup_lines(docs).collect()}
    want = {(d, t if d is None or t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if not x.strip(" \t\x0b\x0c\r") or (d, k) in stays)) for d, t in rows}
    assert len(pairs) > 60 and got == want


def lines_at_the_bound(n: int) -> list[tuple[str, str]]:
    own = np.random.default_rng(11)
    letters = own.integers(97, 123, (n, 69)).astype(np.uint8)
    return [(t, t[:34] + "#" + t[35:]) for t in (bytes(row).decode() for row in letters)]


def test_lines_at_the_bound_share_a_band():
    pairs = lines_at_the_bound(20_000)
    assert all(line_dedup.likeness(a, b) == 0.8 for a, b in pairs[:200])
    left, right = (line_dedup.band_keys([p[k] for p in pairs]) for k in (0, 1))
    assert (left == right).any(axis=1).all()
    assert all(len(np.intersect1d(left[:, k], left[:, j])) == 0 for k in range(3) for j in range(k))


def test_line_dedup_loses_no_link_at_the_bound(spark):
    pairs = lines_at_the_bound(3000)
    data = [(k, "\n".join(a for a, _ in pairs[300 * k : 300 * k + 300])) for k in range(10)]
    data += [(10 + k, "\n".join(b for _, b in pairs[300 * k : 300 * k + 300])) for k in range(10)]
    got = line_dedup.dedup_lines(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_removed for r in got} == {k: 0 if k < 10 else 300 for k in range(20)}
    assert {r.doc_id: r.text for r in got} == {k: t if k < 10 else "" for k, t in data}


def test_lines_that_share_little_seldom_meet():
    """Pairs at similarity 0.125, as chance makes them: a large table has far more of these than of others."""
    letters = np.random.default_rng(12).integers(97, 123, (20_000, 2, 69)).astype(np.uint8)
    letters[:, 1, :20] = letters[:, 0, :20]
    left, right = (line_dedup.band_keys([bytes(row).decode() for row in letters[:, k]]) for k in (0, 1))
    assert (left == right).any(axis=1).mean() < 0.015


def test_equal_lines_are_not_compared(spark, monkeypatch):
    pairs, compared = [], line_dedup._compared

    def seen(found, texts):
        pairs.extend(found.collect())
        return compared(found, texts)

    monkeypatch.setattr(line_dedup, "_compared", seen)
    text = "this line is in every document, whole and unchanged"
    near = [f"another line that is in all of them but for its end {k}" for k in (1, 2)]
    docs = spark.createDataFrame([(k, f"{text}\n{near[k % 2]}\n{text}") for k in range(60)], "doc_id long, text string").repartition(12)
    got = line_dedup.dedup_lines(docs).collect()
    assert {r.doc_id: (r.n_removed, r.text) for r in got} == {k: (3, "") if k else (1, f"{text}\n{near[0]}") for k in range(60)}
    assert len(pairs) == 1


def test_line_dedup_of_nothing(none):
    assert line_dedup.dedup_lines(none).collect() == []


def encoded(text):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], "<u4")


def texts_with_added_tokens() -> list[str]:
    mark = "<|endoftext|>"
    texts = [mark, mark + mark, f"a {mark} b", f"a  {mark}  b", f"x{mark}y", f"\n{mark}\n\nhi {mark}", f"it'{mark}s \t{mark} 12{mark}34", f"{mark[:-1]}{mark}{mark[1:]}", f"É {mark.upper()} ß{mark}\u3000{mark}!"]
    own = np.random.default_rng(5)
    pieces = [mark, mark[:5], " ", "  ", "\n", "\t", "word", "É", "1", ".", "'s", "\u3000"]
    return texts + ["".join(own.choice(pieces, 12)) for _ in range(300)]


def test_added_tokens_are_encoded_as_the_tokenizer_does(tmp_path):
    texts, path = texts_with_added_tokens(), public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    assert tokenizer.encode("a <|endoftext|> b", add_special_tokens=False).ids == [64, 220, 50256, 275]
    want = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert tokens.Encoder(path).encode(texts) == want
    tokenizer.add_special_tokens(["<|end", AddedToken("word", lstrip=True, single_word=True)])
    tokenizer.save(str(tmp_path / "more.json"))
    want = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert tokens.Encoder(str(tmp_path / "more.json")).encode(texts) == want
    tokenizer = Tokenizer.from_file(path)
    tokenizer.add_special_tokens(["<|end", "<|e"])
    tokenizer.save(str(tmp_path / "plain.json"))
    want = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert tokens.Encoder(str(tmp_path / "plain.json")).encode(texts) == want


def test_token_files_and_packing_with_added_tokens(spark, tmp_path):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    data = list(enumerate(texts_with_added_tokens()[:20]))
    want = {k: np.array(tokenizer.encode(t, add_special_tokens=False).ids + [0], "<u4").tobytes() for k, t in data}
    docs = spark.createDataFrame(data, "doc_id long, text string").coalesce(1)
    simple8b.write_ids(docs, str(tmp_path / "ids"))
    assert {r.doc_id: bytes(r.ids) for r in simple8b.read_ids(spark, str(tmp_path / "ids")).collect()} == want
    found: dict[int, bytes] = {}
    for r in sorted(packing.pack(docs).collect(), key=lambda r: (r.doc_id, r.start)):
        assert r.doc_tokens == len(want[r.doc_id]) // 4
        found[r.doc_id] = found.get(r.doc_id, b"") + bytes(r.ids)
    assert found == want


@pytest.mark.parametrize("n, width", [(0, 1), (1, 32), (241, 0), (5000, 16), (9000, 3), (4096, 31), (8192, 1)])
def test_words_round_trip(n, width):
    ids = rng.integers(0, 1 << width, n).astype(np.uint64) >> rng.integers(0, width + 1, n).astype(np.uint64)
    words, offsets = simple8b.pack_words(ids)
    assert (simple8b.unpack_words(words, offsets, n) == ids).all() and len(offsets) == -(-n // simple8b.BLOCK)


def test_token_files(spark, docs, rows, tmp_path):
    simple8b.write_ids(docs, str(tmp_path / "ids"))
    got = simple8b.read_ids(spark, str(tmp_path / "ids")).orderBy("start").collect()
    assert len(got) == len(rows) and [r.doc_id for r in got] == sorted((d for d, _ in rows if d is not None)) + [None, None]
    ids = {d: encoded(t).tobytes() for d, t in rows}
    at = 0
    for r in got:
        assert r.start == at and (r.doc_id is None or bytes(r.ids) == ids[r.doc_id])
        at += len(r.ids) // 4


def test_packing(docs, rows):
    got = sorted(packing.pack(docs).collect(), key=lambda r: (r.sequence_id, r.offset))
    ids = {d: encoded(t) for d, t in rows if d is not None}
    used: dict[int, int] = {}
    lengths: dict[int, int] = {}
    for r in got:
        assert r.offset == lengths.get(r.sequence_id, 0)
        lengths[r.sequence_id] = r.offset + r.length
        if r.doc_id is not None:
            assert r.doc_tokens == len(ids[r.doc_id]) and zlib.crc32(bytes(r.ids)) == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
            used[r.doc_id] = used.get(r.doc_id, 0) + r.length
    copies = {d: sum(x == d for x, _ in rows) for d in ids}
    assert used == {d: len(ids[d]) * copies[d] for d in ids} and max(lengths.values()) <= 1024


def test_packing_is_optimal():
    for _ in range(20):
        points = np.concatenate([[0], np.cumsum(rng.integers(1, 12, 25))])
        prices = rng.choice([0, 8, 64], len(points)).astype(float)
        best = [0.0] + [np.inf] * (len(points) - 1)
        cost = lambda n: 0 if n & (n - 1) == 0 else 32 - n
        for j in range(1, len(points)):
            best[j] = min(best[i] + cost(int(points[j] - points[i])) for i in range(j) if points[j] - points[i] <= 32) + prices[j] + packing.SEQUENCE_COST
        chosen = packing.cuts(points, prices, 32)
        ends = [0, *chosen]
        assert sum(cost(int(points[b] - points[a])) + prices[b] + packing.SEQUENCE_COST for a, b in zip(ends, chosen)) == best[-1]


def test_tokens_of_nothing(spark, none, tmp_path):
    assert packing.pack(none).collect() == []
    simple8b.write_ids(none, str(tmp_path / "none"))
    assert simple8b.read_ids(spark, str(tmp_path / "none")).collect() == []


def test_nearest(spark):
    vectors = rng.normal(size=(400, 6)).round(1)
    rows = [(k, v.tolist()) for k, v in enumerate(vectors)] + [(k, vectors[k].tolist()) for k in (1, 2, 100)]
    rows += [(900, None), (1000, [0.0] * 6), (1001, [None] + [1.0] * 5), (1002, [float("nan")] * 6), (1003, [float("inf")] * 6), (None, [1.0] * 6), (1100, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got: dict[int, list] = {}
    for r in vp_tree.nearest(df, df.filter("vec_id % 100 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert sorted(got) == [0, 100, 200, 300]
    for q, found in got.items():
        d = np.sqrt(((vectors - vectors[q]) ** 2).sum(axis=1))
        order = [k for k in np.lexsort((np.arange(400), d)).tolist() if k != q][:10]
        assert found == [(k, d[k]) for k in order]
    assert vp_tree.nearest(df.filter("false"), df).collect() == []
    tree = vp_tree.build(np.arange(400), vectors, leaf_rows=8)
    relaxed, _ = vp_tree.search(tree, np.arange(400), vectors, 10, factor=1.3)
    exact, _ = vp_tree.search(tree, np.arange(400), vectors, 10)
    assert 0.5 < np.mean([len({*a} & {*b}) / 10 for a, b in zip(relaxed.tolist(), exact.tolist())]) <= 1


def test_few_distances_are_taken_exactly(monkeypatch):
    own, taken = np.random.default_rng(13), []
    for name in {"distances", "pair_distances"} & set(dir(vp_tree)):
        whole = getattr(vp_tree, name)
        monkeypatch.setattr(vp_tree, name, lambda a, b, f=whole: taken.append(f(a, b)) or taken[-1])
    vectors = own.standard_normal((4000, 64))
    vectors[1000:1100] = vectors[:100]  # ties
    for shift, scale in ((0, 1), (1e6, 1e-3), (0, 1e-160), (0, 1e150)):
        rows = shift + scale * vectors
        tree = vp_tree.build(np.arange(4000), rows)
        taken.clear()
        ids, scores = vp_tree.search(tree, np.arange(0, 4000, 100), rows[::100], 10)
        assert (shift, scale) != (0, 1) or sum(x.size for x in taken) < 0.2 * 40 * 4000
        for q, found, score in zip(range(0, 4000, 100), ids, scores):
            d = np.sqrt(((rows - rows[q]) ** 2).sum(axis=1))
            d[q] = np.inf
            want = np.lexsort((np.arange(4000), d))[:10]
            assert (score == d[want]).all() and (found == want).all()


def test_host_rules_and_reputation(spark):
    urls = ["http://A.Example.NET/en/x?q#f", "https://example.net", "x://b.example.com/de/", "x://org/fr/1", "x://xorg/fr/1", None, "nothing", "http://good.example.com/a?b://c", "x://bad.example.com/"]
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(urls)] + [(100 + k, "http://bad.example.com/%d" % k) for k in range(60)] + [(200 + k, "http://good.example.com/") for k in range(60)], "page_id long, url string")
    outcomes = spark.createDataFrame([(100 + k, 0) for k in range(50)] + [(200 + k, 1) for k in range(50)] + [(None, 0), (3, None)], "page_id long, good int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in host_reputation.judge(pages, outcomes, queries.RULES).collect()}
    assert got[0] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[1] == ("example.net", "", None, "allow")
    assert got[2][2:] == ("example.com/de/", "block") and got[3][2:] == ("org/fr/", "allow") and got[4][2] is None
    assert got[5][:2] == got[6][:2] == ("", "")
    assert got[7] == ("good.example.com", "/a", None, "allow")
    assert got[8][3] == "block" and got[159][3] == "block" and len(got) == 129
    assert host_reputation.judge(pages.filter("false"), outcomes, queries.RULES).collect() == []


def test_blank_texts_have_no_tokens_and_stay(spark):
    texts = [None, "", "   ", "\n", " \t\n ", "one", " two\x0bwords\n"]
    df = spark.createDataFrame([(k, t, "en", "a") for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: (r.tokens, r.probability if not r.tokens else None, r.sampled or r.tokens > 0) for r in raking.sample(df).collect()}
    assert got == {**{k: (0, 1.0, True) for k in range(5)}, 5: (1, None, True), 6: (2, None, True)}


def test_raking_meets_the_targets(spark, docs, rows, none):
    cells = spark.createDataFrame([(s, l, "t", 100 + 37 * k) for k, (s, l) in enumerate([(s, l) for s in ("a", "b", None) for l in ("x", "y")])], "source string, lang string, topic string, tokens long")
    targets = {"source": spark.createDataFrame([("a", 0.5), ("b", 0.3), (None, 0.2)], "source string, target double"), "lang": spark.createDataFrame([("x", 0.6), ("y", 0.4)], "lang string, target double")}
    got = raking.rake(cells, targets).toPandas()
    assert abs(got.groupby("lang").weight.sum() - [0.6, 0.4]).max() < 1e-3 and abs(got[got.source == "a"].weight.sum() - 0.5) < 1e-3
    found = raking.sample(docs).collect()
    assert len(found) == len(rows) and all(0 <= r.probability <= 1 for r in found) and all(r.sampled for r in found if r.tokens == 0 and r.doc_id is not None)
    total = sum(r.tokens for r in found)
    assert abs(sum(r.tokens * r.probability for r in found) - 0.5 * total) < 0.01 * total
    assert raking.sample(none).collect() == []


def test_language_gradient_and_accuracy(spark, none):
    weights = {k: v.astype(np.float64) for k, v in language_id.initial(3).items()}
    x, mask, y = rng.integers(0, 1 << 16, (5, 3)), (np.arange(5)[:, None] < [5, 3, 1]).astype(float), np.array([0, 2, 1])
    _, found = language_id.gradients(weights, x, mask, y)
    for name in ("f_hidden", "b_hidden", "out", "b_bias"):
        at = tuple(s // 2 for s in weights[name].shape)
        up, down = ({k: v.copy() for k, v in weights.items()} for _ in range(2))
        up[name][at] += 1e-3
        down[name][at] -= 1e-3
        slope = (language_id.gradients(up, x, mask, y)[0] - language_id.gradients(down, x, mask, y)[0]) / 2e-3
        assert abs(slope - found[name][at]) < 1e-4
    words = {"en": ["the", "and", "ing", "of"], "de": ["der", "und", "ßen", "zu"]}
    texts = [(k, " ".join(rng.choice(words[lang], 30)), lang) for k, lang in enumerate(["en", "de"] * 60)]
    odd = [(1000, None, "en"), (1001, "", "en"), (1002, "12 !", "de"), (1003, "the of and " * 20_000, None), (None, "der und zu", "de")]
    df = spark.createDataFrame(texts + odd, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id.identify(df).collect()}
    assert all(got[k].lang_pred == lang for k, _, lang in texts) and all(got[k].held_out == (zlib.crc32(str(k).encode()) % 4 == 2) for k, _, _ in texts)
    assert [(got[k].lang_pred, got[k].score) for k in (1000, 1001, 1002)] == [("und", 0.0)] * 3
    assert got[1003].lang_pred == "en" and got[None].held_out
    assert language_id.identify(none).collect() == []
    unlabelled = df.select("doc_id", "text", F.lit(None).cast("string").alias("lang"))
    assert {(r.lang_pred, r.score) for r in language_id.identify(unlabelled).collect()} == {("und", 0.0)}


def test_pipeline(spark, docs):
    import corpus_pipeline

    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    found = docs.select(columns)
    for name, stage in corpus_pipeline.STAGES:
        before = found
        found = corpus_pipeline.materialize(stage(spark, found, ""), name)
        if name != "packing":
            assert found.columns == columns and found.count() <= before.count()
    assert found.count() > 0
    assert {n for n, _ in corpus_pipeline.STAGES} == {"language", "lines", "near_dedup", "mixing", "packing"}
    empty = docs.select(columns).filter("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0
