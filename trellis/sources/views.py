"""Operator inputs derived from the driver tables.

Every view is a pure DataFrame expression over whole tables, so its work grows
with the data.  Each has an equivalent DuckDB form in
:mod:`trellis.plans.sqlkit`.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trellis.functions import text as T

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

# Default of the longest token sequence that the seqs view builds (a response
# never exceeds the model's maximum response length; event streams are cut into
# such pieces). Every view of sequences takes it as a parameter.
SEQ_LEN = 128


# Tables whose per-row work is CPU heavy (long texts, arrays).
HEAVY = ("documents", "pages", "conversations", "embeddings")
#: Session setting, off unless set: deal the rows of heavy tables to so many
#: partitions, for input files with fewer row groups than there are cores.
INPUT_PARTITIONS = "trellis.input.partitions"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    n = spark.conf.get(INPUT_PARTITIONS, None) if name in HEAVY else None
    return df.repartition(int(n)) if n else df


def qa_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turn t+1 of a conversation is the prediction, turn t the reference."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    a, b = c.alias("a"), c.alias("b")
    return (a.join(b, (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("b.turn") == F.col("a.turn") + 1))
            .select(F.col("a.conv_id").alias("conv_id"), F.col("a.turn").alias("turn"),
                    F.concat(F.col("a.role"), F.lit(">"), F.col("b.role")).alias("dataset"),
                    F.col("b.text").alias("pred"), F.array(F.col("a.text")).alias("answers"),
                    (F.char_length("a.text") + F.char_length("b.text")).alias("length")))


#: Consecutive documents that are paired in one group.
PAIR_BLOCK = 256
#: Bytes of the documents' files for one task that pairs them: many even tasks, where
#: shuffle partitions merged to about one a core leave a second, nearly empty wave.
PAIR_BYTES = 4 << 20


def table_bytes(spark: SparkSession, sf_dir: str, name: str) -> int:
    """Bytes of a table's files."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()


def doc_pairs(spark: SparkSession, sf_dir: str, text_fn=None) -> DataFrame:
    """Each document is a prediction; its neighbours by id are the references.

    ``answers`` holds the texts of documents ``doc_id-1`` and ``doc_id+1`` that
    exist (one or two), ``length`` is the item's character count and the
    dataset is the document language.  Documents are dealt by blocks of
    consecutive ids; the two at a block's ends go to the next block as well
    (``2 / PAIR_BLOCK`` copies of the text), where ``lag`` and ``lead`` find the
    neighbours of a block's own documents.  ``text_fn`` (a Column function) is
    applied to each document before pairing — e.g. a normaliser, so that
    prediction and references are not normalised again per pair.
    """
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "n_chars")

    def block(x):
        return F.floor(x / PAIR_BLOCK)

    n = max(spark.sparkContext.defaultParallelism, -(-table_bytes(spark, sf_dir, "documents") // PAIR_BYTES))
    dealt = d.withColumn("_b", F.explode(F.array_distinct(F.array(
        block(F.col("doc_id")), block(F.col("doc_id") - 1), block(F.col("doc_id") + 1))))).repartition(n, "_b")
    if text_fn is not None:  # behind the exchange that the window needs anyway
        dealt = dealt.withColumn("text", text_fn(F.col("text")))
    w = Window.partitionBy("_b").orderBy("doc_id")
    near = [F.when(step("doc_id", 1).over(w) == F.col("doc_id") + at, step("text", 1).over(w))
            for step, at in ((F.lag, -1), (F.lead, 1))]
    paired = dealt.select("*", F.filter(F.array(*near), lambda x: x.isNotNull()).alias("answers"))
    return (paired.filter(F.col("_b") == block(F.col("doc_id")))
            .select("doc_id", F.col("lang").alias("dataset"), F.col("text").alias("pred"), "answers",
                    F.col("n_chars").alias("length")))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synthetic model responses over ``documents`` (the context is the text).

    Five shapes by ``doc_id mod 5``: 0 no tags; 1 one quoted span; 2 the span
    upper-cased (ASCII); 3 a span whose word order is reversed; 4 two spans, a
    blank one and a repeated ``Answer:``.
    """
    return responses_from(table(spark, sf_dir, "documents"))


def responses_from(docs: DataFrame) -> DataFrame:
    """The :func:`responses` shapes over any documents frame (batch or stream)."""
    d = docs.select("doc_id", "text")
    w = T.py_split("text")
    up = lambda c: F.translate(c, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    span_a = F.array_join(F.slice(w, 2, 6), " ")
    span_b = F.array_join(F.slice(w, 9, 4), " \n  ")
    span_r = F.array_join(F.reverse(F.slice(w, F.greatest(F.size(w) - 4, F.lit(1)), F.lit(5))), " ")
    truth = F.array_join(F.slice(w, 1, 3), " ")
    shape = F.pmod(F.col("doc_id"), F.lit(5))
    resp = (F.when(shape == 0, F.concat(F.lit("Answer: "), truth))
            .when(shape == 1, F.concat(F.lit("<think>Looking it up. <retrieval>"), span_a,
                                       F.lit("</retrieval></think>\nAnswer: "), truth))
            .when(shape == 2, F.concat(F.lit("<think><retrieval>"), up(span_a),
                                       F.lit("</retrieval> so</think> Answer: "),
                                       F.coalesce(F.try_element_at(w, F.lit(1)), F.lit(""))))
            .when(shape == 3, F.concat(F.lit("  <think><retrieval>"), span_r,
                                       F.lit("</retrieval></think>Answer:"),
                                       F.coalesce(F.try_element_at(w, F.lit(-1)), F.lit("")), F.lit("\n")))
            .otherwise(F.concat(F.lit("<think><retrieval>"), span_a, F.lit("</retrieval> and <retrieval> "),
                                span_b, F.lit(" </retrieval><retrieval>  </retrieval></think> Answer: "),
                                truth, F.lit(" Answer: again"))))
    return d.select("doc_id", resp.alias("response"), truth.alias("ground_truth"),
                    F.col("text").alias("context"))


def tagged_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses in the boxed / tagged answer formats over ``documents``.

    Four shapes by ``doc_id mod 4``: 0 think + boxed answer; 1 think + tagged
    answer; 2 a tagged answer spanning two lines; 3 the bare answer.
    """
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    w = T.py_split("text")
    truth = F.coalesce(F.try_element_at(w, F.lit(2)), F.lit(""))
    head = F.array_join(F.slice(w, 1, 5), " ")
    shape = F.pmod(F.col("doc_id"), F.lit(4))
    resp = (F.when(shape == 0, F.concat(F.lit("<think>"), head, F.lit("</think> so \\boxed{"), truth,
                                        F.lit("} done")))
            .when(shape == 1, F.concat(F.lit("<think>"), head, F.lit("</think>\n <answer> "), truth,
                                       F.lit(" </answer>")))
            .when(shape == 2, F.concat(F.lit("<think>x</think><answer>"), truth, F.lit("\nmore</answer>")))
            .otherwise(F.concat(F.lit(" "), truth, F.lit(" "))))
    return d.select("doc_id", resp.alias("response"), truth.alias("ground_truth"))


#: Bytes of a table's files for one task of :func:`evenly_dealt`.
DEALT_BYTES = 2 << 20


def evenly_dealt(df: DataFrame, sf_dir: str, name: str, keys: list[str]) -> DataFrame:
    """``df``, made from the table ``name``, dealt by ``keys`` to a number of tasks that
    follows the table's bytes: what later joins and windows over these keys sort or
    group in a task does not grow with the table."""
    spark = df.sparkSession
    n = max(spark.sparkContext.defaultParallelism, -(-table_bytes(spark, sf_dir, name) // DEALT_BYTES))
    return df.repartition(n, *keys)


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group-relative input: uid = order key, one response per line item."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("uid"), F.col("l_linenumber").alias("sample_id"),
                     F.col("l_discount").alias("score"), F.col("l_extendedprice").alias("price"))


#: Numbered events by their source: where they are written, and their schema.
_NUMBERED: dict[tuple, tuple] = {}


def numbered_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` with ``rn``, the place of an event among its user's in ``(ts,
    event_id)`` order: a distributed rank (no single-key window), see
    :func:`trellis.operators.sequence.ranked`.

    Ranking sorts the whole table, so it is done once for an application and kept as a
    written table that all sequence views read. It is told by the table's files (their
    number, bytes and time of change): other files are ranked anew."""
    from trellis.operators.sequence import ranked
    from trellis.session import run_folder, scratch_path

    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/events.parquet")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    held = fs.getContentSummary(path)
    key = (run_folder(spark), sf_dir, held.getFileCount(), held.getLength(), fs.getFileStatus(path).getModificationTime())
    if key not in _NUMBERED:
        ev = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")
        numbered, at = ranked(ev, ["user_id"], ["ts", "event_id"], "rn"), scratch_path(spark, f"numbered-events-{uuid.uuid4().hex}")
        numbered.write.option("compression", "zstd").parquet(at)
        _NUMBERED[key] = at, numbered.schema
    at, schema = _NUMBERED[key]
    return spark.read.schema(schema).parquet(at)


def seqs(spark: SparkSession, sf_dir: str, seq_len: int = SEQ_LEN) -> DataFrame:
    """Token-grain sequences from ``events``.

    A user's events in ``(ts, event_id)`` order are cut into pieces of at most
    ``seq_len`` positions (``seq_id = (user_id, piece)``); reward = value,
    eos = purchase (:func:`numbered_events`).
    """
    return numbered_events(spark, sf_dir).select(
        "user_id",
        (F.col("rn") / seq_len).cast("long").alias("piece"),
        (F.col("rn") % seq_len).cast("int").alias("pos"),
        "ts", "event_id",
        F.col("value").alias("reward"),
        (F.col("event_type") == "purchase").alias("is_eos"),
    )


def tokens(spark: SparkSession, sf_dir: str, seq_len: int = SEQ_LEN) -> DataFrame:
    """Response-token table over :func:`seqs`.

    ``mask`` is the eos mask (1 up to and including the first eos of the
    sequence); scores are the event values; critic values and log-probs are
    fixed transforms of the value so that every statistic has real inputs.
    """
    s = seqs(spark, sf_dir, seq_len)
    w = Window.partitionBy("user_id", "piece").orderBy("pos")
    prior = F.max(F.col("is_eos").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    old_lp = -F.log1p("reward") / 10.0
    return s.select(
        "user_id", "piece", "pos", "event_id",
        F.when(F.coalesce(prior, F.lit(0)) == 1, 0).otherwise(1).alias("mask"),
        F.col("reward").alias("score"),
        F.log1p("reward").alias("vals"),
        old_lp.alias("old_lp"),
        (old_lp * 1.1 - 0.01).alias("ref_lp"),
        (old_lp * 0.9).alias("lp"),
        (F.log1p("reward") * 1.05 + 0.01).alias("vpred"),
    )


# Token id of each event type in the array view; purchase is the eos id.
EVENT_TOKEN = {"view": 1, "click": 2, "error": 3, "purchase": 4, "signup": 5}
EOS_ID = 4


def arrays(spark: SparkSession, sf_dir: str, seq_len: int = SEQ_LEN) -> DataFrame:
    """Array form of :func:`seqs`: one row per sequence piece (at most
    ``seq_len`` tokens), ``ids`` = event-type token ids in position order and
    ``vals`` = the event values."""
    r = numbered_events(spark, sf_dir)
    code = F.create_map(*[F.lit(x) for kv in EVENT_TOKEN.items() for x in kv])[F.col("event_type")]
    r = r.select("user_id", (F.col("rn") / seq_len).cast("long").alias("piece"),
                 (F.col("rn") % seq_len).cast("int").alias("pos"), code.cast("long").alias("id"), "value")
    g = r.groupBy("user_id", "piece").agg(F.sort_array(F.collect_list(F.struct("pos", "id", "value"))).alias("s"))
    return g.select("user_id", "piece", F.col("s")["id"].alias("ids"), F.col("s")["value"].alias("vals"))


def step_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-step training log from ``events``: run = event type, step = day
    index; kl = mean value / 1000, n = events that day, seconds = value sum / 100."""
    ev = table(spark, sf_dir, "events")
    day0 = F.lit("2024-01-01").cast("date")
    return (ev.groupBy(F.col("event_type").alias("run"),
                       F.datediff(F.to_date("ts"), day0).alias("step"))
            .agg((F.avg("value") / 1000.0).alias("kl"), F.count(F.lit(1)).alias("n"),
                 (F.sum("value") / 100.0).alias("seconds")))


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("logits"), "label")


#: Documents of one feed batch in the length-balancing input.
FEED_BATCH = 50


def lens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length-balancing input: the documents in id order, cut into feed batches
    of FEED_BATCH items (a short last batch is dropped, as the feed does)."""
    from trellis.operators.curriculum import batches

    d = table(spark, sf_dir, "documents").select("doc_id", T.word_count("text").cast("int").alias("n_tokens"))
    return batches(d, FEED_BATCH, id_col="doc_id").select("batch_id", "doc_id", "n_tokens")
