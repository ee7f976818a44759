"""Every stage of the pipeline against a brute-force version of it, given the stage's own input."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from topicflow.llm import common, line_dedup, raking

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, row string, left string, lines string, named long, _lines string, _places string"
own = random.Random(4)


def prose(n: int) -> list[str]:
    return ["".join(own.choices(["th", "er", "on", "an", "re", "ing", "nd", "ti"], k=own.randrange(2, 5))) for _ in range(n)]


def documents() -> list[tuple]:
    base, line = prose(60), " ".join(prose(14))
    texts = [" ".join(base), " ".join([*base[:-1], "changed"]), " ".join(prose(60))]
    texts += [f"{' '.join(prose(8))}\n{line} {k}\n\n{' '.join(prose(8))}" for k in range(6)] + [f"{line} 7", f"{line} 7\n \t", None, "", "\n", " ".join(prose(400))]
    more = ["x"] * (len(SCHEMA.split(", ")) - 5)
    rows = [(k, t, "en", f"s{k % 3}", len(t or ""), *more) for k, t in enumerate(texts)]
    rows = [(*r[:9], 1, *r[10:]) for r in rows]
    return rows + [rows[3], (None, texts[0], "en", "s", 1, *more[:4], 1, *more[5:]), (None, None, None, None, None, *more[:4], 1, *more[5:])]


@pytest.fixture(scope="module")
def rows():
    return documents()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def smallest(pairs, ids):
    root = {i: i for i in ids}
    while True:
        before = dict(root)
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
        if root == before:
            return root


def test_lines(spark, docs, rows):
    blank = lambda x: not x.strip(" \t\x0b\x0c\r")
    first: dict[str, tuple[int, int]] = {}
    for d, t in sorted({(r[0], r[1]) for r in rows if r[0] is not None}, key=lambda r: r[0]):
        for k, line in enumerate((t or "").split("\n")):
            if not blank(line):
                first.setdefault(line, (d, k))
    names = sorted(first, key=first.get)
    pairs = [(a, b) for a in range(len(names)) for b in range(a) if line_dedup.likeness(names[a], names[b]) >= 0.8]
    stays = {first[names[a]] for a, root in smallest(pairs, range(len(names))).items() if a == root}
    want = []
    for r in rows:
        if r[0] is None or r[1] is None:
            want.append(r if r[0] is None else (*r[:4], None, *r[5:]))
            continue
        old = r[1].split("\n")
        left = [x for k, x in enumerate(old) if blank(x) or (r[0], k) in stays]
        if all(map(blank, old)) or not all(map(blank, left)):
            text = "\n".join(left)
            want.append((r[0], text, *r[2:4], len(text), *r[5:]))
    got = stage("lines")(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr) and len(want) < len(rows)


def test_near_dedup(spark, docs, rows):
    def shingles(t):
        w = common.words(t, fold=True)
        return frozenset(zip(*(w[k:] for k in range(5)))) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset()

    sets = {r[0]: shingles(r[1]) for r in rows if r[0] is not None}
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = smallest(pairs, sets)
    got = stage("near_dedup")(spark, docs, "")
    want = [r for r in rows if r[0] is None or root[r[0]] == r[0]]
    assert got.columns == docs.columns and sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert 1 not in {r[0] for r in want}  # the changed copy goes


def test_language(spark, docs, rows):
    """Texts without a letter go, clean documents of the learned language stay."""
    got = {r.doc_id for r in stage("language")(spark, docs, "").collect()}
    assert got >= {r[0] for r in rows if r[0] is not None and r[1] and r[1].strip()} and not got & {r[0] for r in rows if r[0] is not None and not (r[1] or "").strip()}


def test_mixing(spark, docs):
    """What is drawn stays, whole."""
    drawn = {r.doc_id: r.sampled for r in raking.sample(docs).collect()}
    got = stage("mixing")(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect() if r.doc_id is not None) == sorted(r.doc_id for r in docs.collect() if r.doc_id is not None and drawn[r.doc_id])


def test_packing(spark, docs, rows):
    """Every id of every document is in one piece, at its place."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces: dict[int, list] = {}
    for r in stage("packing")(spark, docs, "").collect():
        if r.doc_id is not None and r.doc_id != 3:  # 3 is there twice
            pieces.setdefault(r.doc_id, []).append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
    for d, t in {(r[0], r[1]) for r in rows if r[0] not in (None, 3)}:
        ids = [i for _, part in sorted(pieces[d]) for i in part]
        assert ids == tokenizer.encode(t or "", add_special_tokens=False).ids + [0]


def test_empty_tables(spark, docs):
    for _, run in corpus_pipeline.STAGES:
        assert run(spark, docs.filter("false"), "").count() == 0
