"""Readers of the given tables and the timed views derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.ordered import following, row_no, rows_block, running_sum, scan, time_block, whole_max


class Tables:
    """``t = Tables(spark, folder)`` then ``t.tok``, ``t.seg`` and so on. Every
    view is lazy and covers its whole source table."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def doc(self) -> DataFrame:
        """Texts need CPU: when the table has fewer file splits than the cluster
        has slots (one small file), spread the rows first."""
        df, slots = self.read("documents"), self.spark.sparkContext.defaultParallelism
        return df.repartition(slots) if len(df.inputFiles()) < slots and df.rdd.getNumPartitions() < slots else df

    @property
    def emb(self) -> DataFrame:
        return self.read("embeddings")

    @property
    def turns(self) -> DataFrame:
        """One row per turn with its words and its place on the session clock."""
        w = self.read("conversations").select(
            F.col("conv_id").alias("session_id"), "turn", "role",
            F.split(F.trim("text"), r"\s+").alias("words"))
        w = w.withColumn("n", F.size("words").cast("bigint")).withColumn("pause", 500 * (F.col("turn") % 4))
        s = scan(w, ["session_id"], ["turn"], rows_block("turn"), upto=running_sum("n"), waited=running_sum("pause"))
        return s.select(
            "session_id", "turn", "role", "words", "n", (F.col("upto") - F.col("n")).alias("seq0"),
            (400 * (F.col("upto") - F.col("n")) + F.col("waited")).alias("t0"),
            F.when(F.col("role") == "user", 0).when(F.col("role") == "assistant", 1).otherwise(2).alias("speaker"),
            F.when(F.col("turn") % 2 == 0, "en").otherwise("ko").alias("lang"))

    @property
    def tok(self) -> DataFrame:
        p = self.turns.select("session_id", "turn", "speaker", "lang", "seq0", "t0", F.posexplode("words").alias("pos", "word"))
        return p.select(
            "session_id", "turn", F.col("pos").cast("bigint").alias("pos"), "word", "speaker", "lang",
            (F.col("seq0") + F.col("pos") + 1).alias("seq"), (F.col("t0") + 400 * F.col("pos")).alias("start_ms"))

    @property
    def seg(self) -> DataFrame:
        return self.turns.select(
            "session_id", F.col("turn").alias("seg_id"), F.col("t0").alias("start_ms"),
            (F.col("t0") + 400 * (F.col("n") - 1) + 100).alias("end_ms"),
            F.array_join("words", " ").alias("text"), "speaker", "lang")

    @property
    def sil(self) -> DataFrame:
        s = scan(self.seg.select("session_id", "seg_id", "start_ms", "end_ms"), ["session_id"], ["seg_id"],
                 rows_block("seg_id"), nxt=following("start_ms"))
        return s.filter(F.col("nxt") - F.col("end_ms") > 400).select(
            "session_id", "seg_id", F.col("end_ms").alias("start_ms"), F.col("nxt").alias("end_ms"))

    @property
    def diar(self) -> DataFrame:
        c = self.tok.withColumn("chunk", F.floor((F.col("seq") - 1) / 7))
        q = c.groupBy("session_id", "chunk").agg(F.min("start_ms").alias("start_ms"), (F.max("start_ms") + 300).alias("end_ms"))
        return q.withColumn("speaker", ((F.col("chunk") * 5 + F.floor(F.col("chunk") / 2)) % 3).cast("int"))

    @property
    def evt(self) -> DataFrame:
        return self.read("events").select(
            "event_id", "user_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).alias("ts_ms"),
            "event_type", "value", F.get_json_object("props", "$.k").cast("bigint").alias("k"))

    def numbered_events(self) -> DataFrame:
        return scan(self.evt, ["user_id"], ["ts_ms", "event_id"], time_block("ts_ms"), n=row_no())

    @property
    def frm(self) -> DataFrame:
        return self.numbered_events().select(F.col("user_id").alias("session_id"), F.col("n").alias("frame_no"), "k")

    @property
    def log(self) -> DataFrame:
        k = F.col("k").cast("string")
        line = (
            F.when(F.col("event_type") == "click", F.concat(
                F.lit("[EndSilence] dur="), k, F.lit(" branch="),
                F.when(F.col("k") >= 80, "long").when(F.col("k") >= 40, "short").otherwise("none")))
            .when(F.col("event_type") == "view", F.concat(F.lit("[CrossBatchFilter] drop=w"), (F.col("k") % 7).cast("string")))
            .when(F.col("event_type") == "error", F.concat(F.lit("[Stall] "), k, F.lit("s without output")))
            .when(F.col("event_type") == "signup", F.concat(F.lit("[NewSpeaker] spk="), (F.col("k") % 3).cast("string")))
            .otherwise(F.concat(F.lit("[Probe] batch="), F.col("event_id").cast("string"), F.lit(" p_ko="), k,
                                F.lit(" p_en="), (100 - F.col("k")).cast("string"))))
        return self.numbered_events().select(F.col("user_id").alias("file_id"), F.col("n").alias("line_no"), line.alias("line"))

    @property
    def pair(self) -> DataFrame:
        """Reference and hypothesis over whole texts: every 7th word dropped,
        every 11th replaced."""
        r = X.hold(self.doc.select("doc_id", "lang", "text"), ref=X.scoring_form("text")).drop("text")
        words = F.filter(F.split("ref", " "), lambda w: w != "")
        kept = F.filter(F.transform(words, lambda x, i: F.when(i % 11 == 3, F.lit("x")).otherwise(x)), lambda x, i: i % 7 != 6)
        return r.select("doc_id", "lang", "ref", F.array_join(kept, " ").alias("hyp"))

    @property
    def bench(self) -> DataFrame:
        d, n = F.col("doc_id"), F.col("n_chars")
        return self.doc.select(
            "doc_id", F.col("lang").alias("language"), F.concat(F.lit("c"), (d % 4).cast("string")).alias("category"),
            (n * 66).alias("duration_ms"), (n * (5 + d % 20)).alias("proc_ms"), (d % 5).alias("subs"), (d % 3).alias("ins"),
            (d % 4).alias("dels"), F.greatest(F.floor(n / 6), F.lit(1).cast("bigint")).alias("ref_words"))

    @property
    def snap(self) -> DataFrame:
        """Snapshots under retention: message ``seq`` holds lines seq-4..seq, the
        last one still without its last word, which the next message brings."""
        s = scan(self.seg.select("session_id", "seg_id", "text"), ["session_id"], ["seg_id"], rows_block("seg_id"),
                 top=whole_max("seg_id"))
        seqs = F.sequence("seg_id", F.least(F.col("seg_id") + 4, F.col("top")))
        return s.select(
            "session_id", F.explode(seqs).alias("seq"), F.col("seg_id").alias("line_id"), "text",
        ).select(
            "session_id", "seq", (F.col("line_id") - F.greatest(F.col("seq") - 4, F.lit(0))).alias("line_idx"), "line_id",
            F.when(F.col("seq") == F.col("line_id"), F.regexp_replace("text", r"\s*\S+$", "")).otherwise(F.col("text")).alias("line_text"))

    @property
    def dict_entries(self) -> DataFrame:
        """Word entries: base from the benchmark texts, user overlay from
        the conversations."""
        base = self.read("benchmark").select(F.explode(X.tokens("text")).alias("wrong")).distinct()
        base = base.select("wrong", F.upper("wrong").alias("correct"), F.lit("base").alias("src"))
        user = self.read("conversations").select(F.explode(X.tokens("text")).alias("wrong")).distinct()
        user = user.select("wrong", F.reverse("wrong").alias("correct"), F.lit("user").alias("src"))
        return base.unionByName(user)
