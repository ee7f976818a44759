import pytest
from pyspark.sql import functions as F

from topicflow.functions import fixed
from topicflow.functions.keywords import keyword_variants, label_keywords
from topicflow.operators import taxonomy, topic
from topicflow.plans.setup import choose_setup


def parse(spark, *specs):
    rows = [(str(i), "t", s) for i, s in enumerate(specs)]
    parsed = taxonomy.parse_specs(spark.createDataFrame(rows, "taxonomy_id string, topic string, spec string"))
    return parsed.orderBy("taxonomy_id", "priority").collect()


@pytest.mark.parametrize(
    "word, forms",
    [
        ("vision", "vision visions visioning visioned"),
        ("study", "study studys studies studying studyed"),
        ("image", "image images imaging imaged"),
        ("bus", "bus"),
        ("by", "by bys"),
        ("sky", "sky skys skies"),
        ("cross-modal", "cross-modal cross-modals cross-modaling cross-modaled cross_modal crossmodal"),
        ("Deep net", "Deep_net Deep_nets Deep_neting Deep_neted Deep-net Deepnet"),
    ],
)
def test_keyword_variants(spark, word, forms):
    got = spark.createDataFrame([(word,)], "w string").select(keyword_variants(F.col("w")).alias("v")).first().v
    assert sorted(got) == sorted(f.replace("_", " ") for f in forms.split())


def test_label_keywords(spark):
    df = spark.createDataFrame([("视觉语言融合",), ("跨模态检索：study",)], "label string")
    first, second = [r.k for r in df.select(label_keywords(F.col("label")).alias("k")).collect()]
    assert first == sorted(
        "visual vision image language linguistic text nlp fusion integration multimodal 视觉语言融合".split()
    )
    assert set(second) == set(
        "cross-modal multimodal retrieval search matching 跨模态检索 study studys studies studying studyed".split()
    )


def test_specs(spark):
    good = parse(spark, " A : x , Y ,, x;B:z; ")
    assert [(r.priority, r.label) for r in good] == [(1, "A"), (2, "B")]
    assert good[0].keywords == ["A", "As", "x", "y"] and good[0].error is None


def test_repeated_label_keeps_its_place_and_takes_the_last_keywords(spark):
    rows = parse(spark, "A:x;B:z;A:w")
    assert [(r.label, r.keywords) for r in rows] == [("A", ["A", "As", "w"]), ("B", ["B", "Bs", "z"])]


@pytest.mark.parametrize(
    "spec, error",
    [
        ("A", "missing colon"),
        ("A:x; ;B", "missing colon"),
        (" :x", "empty label"),
        ("   ", "empty categories"),
        (" ; ; ", "no category"),
        ("A:x;:y;B", "empty label"),
        ("", "topic and categories must be given together"),
    ],
)
def test_wrong_specs(spark, spec, error):
    (row,) = parse(spark, spec)
    assert (row.error, row.label) == (error, None)
    with pytest.raises(ValueError, match=error):
        taxonomy.custom_rows(spark, "t", spec)


def test_compiled_category(spark):
    (row,) = taxonomy.custom_rows(spark, "t", "Graphs:c++,graph net")
    assert (row.priority, row.key, row.label) == (1, "custom_1", "Graphs")
    assert row.description == "包含关键词：Graphs, Graphsed, Graphsing, c++, graph net"
    assert row.patterns == [r"\bGraphs\b", r"\bGraphsed\b", r"\bGraphsing\b", r"\bc\+\+\b", r"\bgraph\ net\b"]


def test_description_has_all_keywords(spark):
    (row,) = taxonomy.custom_rows(spark, "t", "Zz:" + ",".join(f"k{i:02d}" for i in range(12)))
    assert row.description == "包含关键词：Zz, Zzs, k00, k01, k02, k03, k04, k05, k06, k07, k08, k09, k10, k11"


def test_compiled_topic(spark):
    row = topic.compile_topics(spark.createDataFrame([("a-b, sky",)], "topic string")).first()
    assert row.topic_regex == "|".join(
        rf"\b{w}\b" for w in sorted(["a\\ b", "a\\-b", "a\\-bs", "ab", "sky", "skys", "skies"], key=lambda w: w.replace("\\", ""))
    )
    assert row.topic_description == "Topic: a-b, sky (keywords: a-b, sky)"


def test_definitions(spark):
    table = taxonomy.rows_table(spark, taxonomy.custom_rows(spark, "t", "Red:r;Blue:b"), "x")
    assert taxonomy.definitions_text(table, "其他/未归类").first().definitions == (
        "1. **Red** (key: custom_1)\n   包含关键词：Red, Reds, r\n\n"
        "2. **Blue** (key: custom_2)\n   包含关键词：Blue, Blued, Blues, Bluing, b\n\n"
        "3. **其他/未归类** (key: other)\n   无法归入以上任何类别的论文"
    )
    builtin = taxonomy.definitions_json(taxonomy.builtin_table(spark), fixed.BUILTIN_DEFAULT_LABEL).first().definitions
    assert builtin.startswith('[{"key":"evaluation"') and builtin.count('"key"') == 10


def test_setup_needs_topic_and_categories(spark):
    assert choose_setup(spark).topic is None
    assert [r.label for r in choose_setup(spark, "red", "A:x").rows] == ["A"]
    for given in (("red", None), (None, "A:x"), ("red", "")):
        with pytest.raises(ValueError):
            choose_setup(spark, *given)


def test_fingerprint_follows_topic_and_taxonomy(spark):
    prints = {choose_setup(spark, *s).fingerprint() for s in [(None, None), ("t", "A:x"), ("t", "A:y"), ("u", "A:x")]}
    assert len(prints) == 4
    one = choose_setup(spark, "t", "A:x")
    assert len({one.fingerprint(), one.fingerprint(0.6), one.fingerprint(0.7), one.fingerprint(0.6, "a"), one.fingerprint(0.6, "b"), one.fingerprint(0.6, "a", "c")}) == 6
    assert one.fingerprint(0.6, "a") == one.fingerprint(0.6, "a")
