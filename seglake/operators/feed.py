"""Snapshot feed: deltas, rebuilds, histories, utterance events. Messages stay
exploded, one row per line: session keys, seq (dense from the first message),
line_idx, line_id, line_text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.ordered import prev, row_no, rows_block, running_sum, scan, whole_sum


def encode_deltas(snapshots: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(messages, new_lines). A message tells how many lines fell off the front
    and how many lines there are; its new lines are everything after the common
    prefix with the message before. Line identity in a message is (id, text).

    The lines of one message are bounded by the retention of the feed, so they are
    one array, and the arrays of two messages in a row are compared in place."""
    mk = [*keys, "seq"]
    held = snapshots.groupBy(*mk).agg(F.array_sort(F.collect_list(F.struct("line_idx", "line_id", "line_text"))).alias("_l"))
    held = held.withColumn("_l", F.transform("_l", lambda x: F.struct(x["line_id"].alias("line_id"), x["line_text"].alias("line_text"))))
    m = scan(held, keys, ["seq"], rows_block("seq"), _p=prev("_l"))
    fell = F.array_position("_p", F.get("_l", F.lit(0)))
    m = m.withColumn("lines_pruned", F.when(F.col("_p").isNull(), 0).when(fell > 0, fell - 1).otherwise(F.size("_p")).cast("bigint"))
    places = F.sequence(F.lit(0), F.size("_l") - 1)
    differs = F.filter(places, lambda i: ~F.get(F.col("_l"), i).eqNullSafe(F.get(F.col("_p"), (i + F.col("lines_pruned")).cast("int"))))
    m = m.withColumn("_common", F.when(F.col("_p").isNull(), 0).otherwise(F.coalesce(F.get(differs, F.lit(0)), F.size("_l"))))
    n = F.size("_l").cast("bigint")
    messages = m.select(*mk, F.when(F.col("_p").isNull(), "snapshot").otherwise("diff").alias("type"), n.alias("n_lines"), "lines_pruned",
                        (n - F.col("_common")).alias("n_new"))
    rest = F.slice("_l", F.col("_common") + 1, F.size("_l"))
    new = m.select(*mk, "_common", F.posexplode(rest).alias("_i", "_line"))
    return messages, new.select(*mk, (F.col("_i") + F.col("_common")).cast("bigint").alias("line_idx"), "_line.line_id", "_line.line_text")


def decode_deltas(messages: DataFrame, new_lines: DataFrame, keys: list[str], last_seq: DataFrame) -> DataFrame:
    """Lines after message ``last_seq`` (keys, at). A place in the list is fixed
    on the axis (index + everything pruned so far); the latest message that
    wrote a place and did not cut it off later holds its line. Adds ``desync``."""
    m = scan(messages, keys, ["seq"], rows_block("seq"), _off=running_sum("lines_pruned"))
    upto = m.join(last_seq, keys).filter("seq <= at")
    base = upto.groupBy(*keys).agg(F.max(F.when(F.col("type") == "snapshot", F.col("seq"))).alias("_base"))
    live = upto.join(base, keys).filter("seq >= _base")
    w = new_lines.join(live.select(*keys, "seq", "_off"), [*keys, "seq"]).withColumn("place", F.col("line_idx") + F.col("_off"))
    end = live.filter("seq = at").select(*keys, "_off", "n_lines").withColumnRenamed("_off", "_lo")
    got = w.groupBy(*keys, "place").agg(F.max_by(F.struct("line_id", "line_text"), "seq").alias("l")).join(end, keys)
    kept = got.filter((F.col("place") >= F.col("_lo")) & (F.col("place") < F.col("_lo") + F.col("n_lines")))
    n = kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return kept.join(n, keys).select(*keys, (F.col("place") - F.col("_lo")).alias("line_idx"), "l.line_id", "l.line_text", (F.col("_n") != F.col("n_lines")).alias("desync"))


def upsert_history(lines: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Finalized history: last version per line id, and how often a rendered
    field changed (an equal version is not a change)."""
    lk = [*keys, "line_id"]
    s = scan(lines, lk, ["seq"], rows_block("seq"), _p=prev(F.struct(*fields)))
    changed = F.col("_p").isNull() | ~F.col("_p").eqNullSafe(F.struct(*fields))
    return s.groupBy(*lk).agg(F.max_by(F.struct(*fields), "seq").alias("v"), F.count_if(changed).alias("writes")).select(*lk, "v.*", "writes")


def utterance_events(snapshots: DataFrame, keys: list[str]) -> DataFrame:
    """Per message: final when lines were added, else interim when the buffer has
    text; end of utterance when a silence starts after the last word.
    ``snapshots``: seq, n_lines, last_end, buffer, silence_start."""
    s = scan(snapshots, keys, ["seq"], rows_block("seq"), _sent=prev("n_lines"))
    final = F.col("n_lines") > F.coalesce("_sent", F.lit(0))
    s = s.withColumn("event", F.when(final, "final").when(X.strip("buffer") != "", "interim")).withColumn("n_new", F.when(final, F.col("n_lines") - F.coalesce("_sent", F.lit(0))).otherwise(0))
    return s.withColumn("utterance_end", F.coalesce((F.col("silence_start") >= F.col("last_end")) & (F.col("n_lines") > 0), F.lit(False))).select(*keys, "seq", "event", "n_new", "utterance_end")


def join_text(a, b):
    x, y = F.trim(a), F.trim(F.coalesce(b, F.lit("")))
    return F.when(x == "", y).when(y == "", x).otherwise(F.concat(x, F.lit(" "), y))


def freeze(lines: DataFrame, tails: DataFrame, keys: list[str]) -> DataFrame:
    """Lines of a paused session: all visible lines final, the buffer joined to
    the last one, or one carrier line when there is none."""
    vis = lines.filter((F.coalesce("line_text", F.lit("")) != "") & (F.col("speaker") != -2))
    last = vis.groupBy(*keys).agg(F.max("line_idx").alias("_last"))
    j = vis.join(last, keys).join(tails, keys, "left")
    text = F.when(F.col("line_idx") == F.col("_last"), join_text(F.col("line_text"), F.col("tail"))).otherwise(F.col("line_text"))
    kept = j.select(*keys, "line_idx", "speaker", text.alias("line_text"), F.lit(True).alias("finalized"))
    empty = tails.join(last, keys, "left_anti").filter(F.trim("tail") != "").select(
        *keys, F.lit(None).cast("bigint").alias("line_idx"), F.lit(1).alias("speaker"), F.trim("tail").alias("line_text"), F.lit(True).alias("finalized"))
    return kept.unionByName(empty)


def commit_all_but_last(updates: DataFrame, keys: list[str]) -> DataFrame:
    """Newly committed words per update of a growing text (all but its last word;
    everything on the flush row). ``updates``: seq, text, flush."""
    w = X.words("text")
    u = updates.withColumn("_n", F.greatest(F.when(F.col("flush"), F.size(w)).otherwise(F.size(w) - 1), F.lit(0)))
    s = scan(u, keys, ["seq"], rows_block("seq"), _done=prev("_n", 0))
    new = F.slice(w, F.col("_done") + 1, F.greatest(F.col("_n") - F.col("_done"), F.lit(0)))
    return s.select(*keys, "seq", F.array_join(new, " ").alias("committed")).filter("committed <> ''")


def settle(attempts: DataFrame, keys: list[str], cap: int = 2) -> DataFrame:
    """Result per key: the last success, or empty text after ``cap`` failures."""
    g = attempts.groupBy(*keys).agg(F.max_by("result", F.when(F.coalesce("result", F.lit("")) != "", F.col("at"))).alias("r"), F.count_if(F.coalesce("result", F.lit("")) == "").alias("failures"))
    return g.select(*keys, F.when(F.col("r").isNotNull(), F.col("r")).when(F.col("failures") >= cap, "").alias("translation"), "failures")


def rederive(lines: DataFrame, keys: list[str], order: str, revision: int, scope: int = 20) -> DataFrame:
    """After a dictionary change only the last ``scope`` final lines become stale;
    a line without any value is always derived. Needs translation, revision."""
    s = scan(lines, keys, [order], rows_block(order), _no=row_no(), _all=whole_sum(F.lit(1)))
    recent = F.col("_no") > F.col("_all") - scope
    stale = F.col("translation").isNull() | (recent & (F.col("revision") < revision))
    return s.withColumn("derive", stale).drop("_no", "_all")
