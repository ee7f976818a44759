"""What the checked queries read, derived by Spark from the given tables.

Each view has the same content as the SQL text of the same name in sqltext.py.
All views cover their whole table.
"""

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topicflow.functions.fixed import BUILTIN_DEFAULT_LABEL, CUSTOM_DEFAULT_LABEL
from topicflow.functions.text import paper_hash, strip
from topicflow.operators import taxonomy
from topicflow.operators.classify import classify_rules
from topicflow.operators.topic import filter_topic
from topicflow.session import spread

TOPIC = "this,with,license"
SPEC = "Licensing:license,apache;Credentials:token;Deixis:this,here;Prose:with,from"
MORE_SPECS = {
    "articles": "Le:le,la,les;Der:der,die,das;The:the",
    "links": "And:and,or;Of:of;Zu:zu,von",
    "vision": "视觉语言融合:of the,on the;跨模态检索:to,que",
}
YEARS = [2021, 2022, 2023, 2025]
ORDER_YEARS = [1996, 1997, 1998, 2003]

# The documents are invented prose without research terms, so for the built-in
# topic and taxonomy some frequent words are read as such terms.
VOCABULARY = (
    ("with", "in-context"),
    ("this", "few-shot"),
    ("from", "ICL"),
    ("des", "in context"),
    ("les", "Many-shot"),
    ("heen", "new benchmark"),
    ("ining", "dataset"),
    ("rend", "tool use"),
    ("ist", "agents"),
    ("nicht", "Chain-of-Thought"),
    ("heea", "reasoning"),
    ("edst", "step"),
    ("edes", "prompt tuning"),
    ("se", "Template"),
    ("los", "design"),
    ("ench", "retrieval-augmented"),
    ("heed", "errors"),
    ("elle", "KV cache"),
    ("inha", "distillation"),
    ("del", "hallucination"),
    ("hesh", "robustness"),
    ("avec", "Provably"),
    ("dem", "mechanisms"),
    ("erha", "training"),
    ("oned", "fine-tuning"),
)

PART_LABELS = {
    "ECONOMY": "视觉语言融合",
    "LARGE": "跨模态检索、Image-Search",
    "MEDIUM": "模型训练：deep learning",
    "PROMO": "安全 study",
    "SMALL": "生成，应用",
    "STANDARD": "Graphs",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """A table whose rows are heavy to work on."""
    return spread(table(spark, sf_dir, name))


def _year() -> Column:
    return (F.lit(2021) + F.col("doc_id") % 5).cast("int")


def _papers(documents: DataFrame) -> DataFrame:
    rest = F.when(
        F.contains("text", F.lit("\n")),
        F.substring(F.col("text"), F.instr("text", "\n") + 1, F.length("text")),
    ).otherwise("")
    return documents.select(
        F.concat_ws("_", F.upper("lang"), _year(), "doc_id").alias("id"),
        F.upper("lang").alias("conf"),
        _year().alias("year"),
        strip(F.substring_index("text", "\n", 1)).alias("title"),
        strip(rest).alias("abstract"),
        "doc_id",
    )


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _papers(texts(spark, sf_dir))


def research_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    for word, term in VOCABULARY:
        text = F.replace(text, F.lit(f" {word} "), F.lit(f" {term} "))
    documents = texts(spark, sf_dir)
    # Exploding a one-element array computes the long replacement once per row.
    return _papers(documents.select("doc_id", "lang", F.explode(F.array(text)).alias("text")))


def on_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_topic(papers(spark, sf_dir), TOPIC)


@lru_cache
def custom_rows(spark: SparkSession):
    """The custom taxonomy, compiled once per session."""
    return taxonomy.custom_rows(spark, TOPIC, SPEC)


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On-topic papers with their category of the custom taxonomy."""
    return classify_rules(on_topic(spark, sf_dir), custom_rows(spark), CUSTOM_DEFAULT_LABEL).withColumn(
        "category", F.col("category_label")
    )


def research_classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_rules(
        filter_topic(research_papers(spark, sf_dir)), taxonomy.builtin_rows(), BUILTIN_DEFAULT_LABEL
    ).withColumn("category", F.col("category_label"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One made prediction per labelled text, from the lowest doc_id that has it."""
    key = (
        F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "custom_1")
        .when((F.col("quality") == 1) & (F.col("toxic") == 1), "custom_3")
        .when(F.col("toxic") == 1, "custom_2")
        .otherwise("unknown")
    )
    label = (
        F.when(F.col("category_key") == "custom_1", "Licensing")
        .when(F.col("category_key") == "custom_2", "Credentials")
        .when(F.col("category_key") == "custom_3", "Deixis")
        .otherwise(CUSTOM_DEFAULT_LABEL)
    )
    # hashed where the texts lie: only hashes meet the labels
    hashes = papers(spark, sf_dir).select(paper_hash(F.col("title"), F.col("abstract")).alias("paper_hash"), "doc_id")
    return (
        hashes.join(table(spark, sf_dir, "labels"), "doc_id")
        .select("paper_hash", "doc_id", key.alias("category_key"))
        .groupBy("paper_hash")
        .agg(F.min(F.struct("doc_id", "category_key")).alias("p"))
        .select("paper_hash", "p.*")
        .select(
            "paper_hash",
            "category_key",
            label.alias("category_label"),
            ((F.col("doc_id") % 11).cast("double") / 10).alias("confidence"),
            F.concat(F.lit("seen in "), F.col("doc_id")).alias("reasoning"),
        )
    )


def known_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predictions a cache holds already; the others are the shipped scorer's."""
    return predictions(spark, sf_dir).filter("confidence < 0.3")


def stored_answers(spark: SparkSession, sf_dir: str, ids: DataFrame) -> DataFrame:
    """What the shipped scorer answers with: the predictions of the texts of `ids` (id, title, abstract).

    A text goes by its lowest id.  Some answers lack a category, some a confidence, and some texts are refused.
    """
    named = ids.groupBy(paper_hash(F.col("title"), F.col("abstract")).alias("paper_hash")).agg(F.min("id").alias("id"))
    tenth = F.round(F.col("confidence") * 10).cast("int")
    return predictions(spark, sf_dir).join(named, "paper_hash").select(
        "id",
        F.when(tenth != 7, F.col("category_key")).alias("category_key"),
        F.when(tenth != 8, F.col("confidence")).alias("confidence"),
        "reasoning",
        F.when((tenth == 10) & (F.col("category_key") != "custom_1"), F.concat(F.lit("refused, "), "reasoning")).alias("error"),
    )


def orders_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("category")
    )


# --- landed notes and pages -------------------------------------------------


def _note_json(documents: DataFrame) -> DataFrame:
    """One listing note per document: bare fields or {"value": ...}, some fields missing."""
    number = F.col("doc_id")
    line = F.substring_index("text", "\n", 1)
    rest = F.when(
        F.contains("text", F.lit("\n")),
        F.substring(F.col("text"), F.instr("text", "\n") + 1, F.length("text")),
    ).otherwise("")
    conf, year = F.upper("lang"), _year()
    place = F.concat(conf, F.lit(".cc/"), year.cast("string"))
    fields = {
        "title": F.concat(F.lit("  "), line, F.lit("\t")),
        "abstract": rest,
        "TL;DR": F.when(number % 5 == 1, "").when(number % 5 == 2, F.concat(F.lit("About "), "source")),
        "TLDR": F.when((number % 5).isin(0, 1, 3), F.concat(F.lit(" short "), "source")),
        "venueid": F.when(number % 3 == 0, F.concat(place, F.lit("/Conference"))).when(
            number % 3 == 2, F.concat(place, F.lit("/Workshop"))
        ),
        "venue": F.when(number % 4 == 0, F.concat_ws(" ", conf, year, F.lit("poster")))
        .when(number % 4 == 1, "Submitted elsewhere")
        .when(number % 4 == 2, "Accept (oral)"),
    }
    note_id = F.when(number % 7 != 3, F.concat(F.lit("n"), number)).alias("id")
    bare = F.struct(*[v.alias(k) for k, v in fields.items()]).alias("content")
    wrapped = F.struct(
        *[F.when(v.isNotNull(), F.struct(v.alias("value"))).alias(k) for k, v in fields.items()]
    ).alias("content")
    note = F.when(number % 2 == 0, F.to_json(F.struct(note_id, bare))).otherwise(
        F.to_json(F.struct(note_id, wrapped))
    )
    return documents.select("doc_id", conf.alias("conf"), year.alias("year"), note.alias("note"))


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = _note_json(texts(spark, sf_dir))
    # As in a landed page, a note is an element of a list.
    return listed.select("doc_id", "conf", "year", F.explode(F.array(F.parse_json("note"))).alias("note"))


def landed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing pages of up to 100 documents each, for several candidate places.

    Candidate 1 lists rejected notes, 2 (English) is filtered by venue id, 5 (the
    other languages) lists everything, 13 lists every third note, so some of its
    pages are empty.
    """
    number = F.col("doc_id")
    accepted = ((number % 3 == 0) & (number % 2 == 0)) | (number % 4 == 0) | (number % 4 == 2)
    english = F.col("conf") == "EN"
    places = F.array(
        F.struct(F.lit(1).alias("candidate"), (~accepted).alias("listed")),
        F.struct(
            F.when(english, 2).otherwise(5).alias("candidate"),
            F.when(english, number % 3 == 0).otherwise(True).alias("listed"),
        ),
        F.struct(F.lit(13).alias("candidate"), (number % 3 == 0).alias("listed")),
    )
    block = F.floor(number / 100)
    listed = (
        _note_json(texts(spark, sf_dir))
        .select("conf", "year", "doc_id", "note", F.explode(places).alias("place"))
        .select("conf", "year", "place.candidate", (block * 1000).alias("offset"), "doc_id",
                F.when(F.col("place.listed"), F.col("note")).alias("note"))
    )
    # A page holds at most 100 documents, whatever the table's size.
    items = F.transform(
        F.filter(F.array_sort(F.collect_list(F.struct("doc_id", "note"))), lambda n: n.note.isNotNull()),
        lambda n: n.note,
    )
    shape = F.col("offset") / 1000 % 4
    array = F.concat(F.lit("["), F.array_join("items", ","), F.lit("]"))
    payload = (
        F.when(shape == 0, array)
        .when(shape == 1, F.concat(F.lit('{"notes": '), array, F.lit("}")))
        .when(shape == 2, F.concat(F.lit('{"notes": null, "data": '), array, F.lit("}")))
        .otherwise(F.concat(F.lit('{"count": 1, "results": '), array, F.lit("}")))
    )
    return (
        listed.groupBy("conf", "year", "candidate", "offset")
        .agg(items.alias("items"))
        .select("conf", "year", "candidate", "offset", payload.alias("payload"))
    )


def web_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages that came back where a listing page was asked for."""
    return table(spark, sf_dir, "pages").select(
        F.lit("WEB").alias("conf"),
        F.lit(2021).alias("year"),
        F.lit(0).alias("candidate"),
        (F.col("page_id") * 1000).alias("offset"),
        F.col("html").alias("payload"),
    )


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.upper("event_type").alias("conf"),
        (F.lit(2021) + F.col("user_id") % 5).cast("int").alias("year"),
        F.col("event_id").alias("attempt"),
        F.concat(F.lit("attempt failed: "), "props").alias("error"),
    )


# --- specifications and keywords ---------------------------------------------


def specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One category specification per part, some of them wrong."""
    label = F.create_map(*[F.lit(v) for pair in PART_LABELS.items() for v in pair])[F.col("p_type")]
    own = F.concat(label, F.lit(": "), F.replace("p_name", F.lit(" "), F.lit(",")), F.lit(",, "), F.upper("p_brand"))
    brand = F.concat(F.col("p_brand"), F.lit(":"), F.col("p_name"), F.lit(" ,C++"))
    size = F.col("p_size")
    spec = (
        F.when(size == 7, F.concat(own, F.lit(";"), "p_brand"))
        .when(size == 13, F.concat(own, F.lit("; :"), "p_name"))
        .when(size == 21, F.lit(" "))
        .when(size == 25, F.lit(" ; ;"))
        .when(size == 33, F.concat_ws(";", own, brand, F.concat(label, F.lit(":again "), F.col("p_name"))))
        .otherwise(F.concat(own, F.lit(" ;;"), brand, F.lit(";")))
    )
    return texts(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("taxonomy_id"),
        F.when(size == 44, "").otherwise(F.concat_ws(", ", "p_name", F.lower("p_type"))).alias("topic"),
        spec.alias("spec"),
    )


def keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names, brands with a hyphen, and every word of every document."""
    parts = table(spark, sf_dir, "part")
    words = texts(spark, sf_dir).select(F.explode(F.split("text", " ")).alias("keyword"))
    return (
        parts.select(F.col("p_name").alias("keyword"))
        .unionByName(parts.select(F.replace("p_brand", F.lit("#"), F.lit("-")).alias("keyword")))
        .unionByName(words)
        .filter(F.col("keyword") != "")
        .distinct()
    )
