"""Chat formatting by quotation linking, with DataFrame functions only.

The lines of a message are read with their level of quotation (the number of leading ``>``). Runs of lines of one
level, cut at blank lines, are passages; passages and their single lines are hashed after lower-casing
and joining white space. Quoted hashes are joined to those of what messages say themselves: to the earliest
message with the passage in the same conversation before the reply, else to that of another conversation before it, if the passage has
``least`` characters and at most ``origins`` messages of different texts say it: what is short, or said in many ways, tells nothing of where
it comes from, while copies of one message count once and the earliest stands for them. So a passage meets one message however many repeat it. A reply's parent is the message
that most of its least-nested quoted characters come from; without such a match it is the turn before in
the conversation. Parents always come earlier in the order (conv_id, turn, place in the input), so there are
no cycles; roots and depths are found by pointer doubling. A global range sort numbers the messages of each
thread, parents first, and no thread or conversation is ever in one task.

Defined results: null text counts as empty; a null role is shown as "user"; a message with a null conv_id is
a conversation of its own; null turns come last; repeated rows are separate messages, told apart by their
place in the input; lines that only say who wrote what follows are dropped with the quotes; a message that
only quotes has an empty text; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from genoloom.llm import shared

SLICE, LEAST, ORIGINS = 4096, 24, 1
#: Lines before a quotation that say who wrote it.
ATTRIBUTION = r"(?i)^.{0,200}\b(wrote|writes|said|schrieb|schreibt|a écrit|escribió|dijo)\s*:$"
_MARKS = r"^(?:[ \t]*>)+"


def _normal(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def passages(messages: DataFrame, text_col: str = "_text") -> DataFrame:
    """Adds _own (the text without quotations) and _passages: array of (level, hash, n), lines of passages too."""
    lines = F.split(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"\r\n?", "\n"), "\n")
    level = lambda x: F.length(F.regexp_replace(F.regexp_extract(x, _MARKS, 0), "[^>]", ""))
    out = messages.withColumn("_lines", F.transform(lines, lambda x: F.struct(level(x).alias("v"), F.when(x.rlike(_MARKS), F.trim(F.regexp_replace(x, _MARKS, ""))).otherwise(F.rtrim(x)).alias("t"))))
    follows = lambda i: F.coalesce(F.try_element_at("_lines", (i + 2).cast("int"))["v"], F.lit(-1))
    out = out.withColumn("_lines", F.filter("_lines", lambda x, i: ~(x["t"].rlike(ATTRIBUTION) & (follows(i) == x["v"] + 1))))
    before = lambda i: F.element_at("_lines", i - 1)
    n = F.size("_lines")
    out = out.withColumn("_cuts", F.when(n > 0, F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.when(i == 1, True).otherwise((F.element_at("_lines", i)["v"] != F.element_at("_lines", F.greatest(i - 1, F.lit(1)))["v"]) | (before(F.greatest(i, F.lit(2)))["t"] == "")))).otherwise(F.array().cast("array<int>")))
    end = lambda k: F.coalesce(F.try_element_at("_cuts", (k + 2).cast("int")), n + 1)
    out = out.withColumn("_runs", F.transform("_cuts", lambda s, k: F.struct(F.element_at("_lines", s)["v"].alias("v"), F.transform(F.slice("_lines", s, end(k) - s), lambda x: _normal(x["t"])).alias("ts"))))
    whole = F.transform("_runs", lambda r: F.struct(r["v"].alias("v"), F.trim(F.array_join(F.filter(r["ts"], lambda t: t != ""), " ")).alias("t")))
    single = F.flatten(F.transform("_runs", lambda r: F.transform(r["ts"], lambda t: F.struct(r["v"].alias("v"), t.alias("t")))))
    out = out.withColumn("_all", F.array_distinct(F.filter(F.concat(whole, single), lambda x: x["t"] != "")))
    out = out.withColumn("_passages", F.transform("_all", lambda x: F.struct(x["v"].alias("level"), F.unhex(F.md5(x["t"])).alias("hash"), F.length(x["t"]).alias("n"))))
    own = F.array_join(F.transform(F.filter("_lines", lambda x: x["v"] == 0), lambda x: x["t"]), "\n")
    own = F.regexp_replace(F.regexp_replace(own, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")
    return out.withColumn("_own", own).drop("_lines", "_cuts", "_runs", "_all")


def _previous(m: DataFrame) -> DataFrame:
    """_id and _prev, the message before in its conversation; a conversation is cut into slices of ``SLICE`` turns."""
    m = m.select("_id", "_conv", "_turn", F.floor(F.coalesce("_turn", F.lit((1 << 63) - 1)) / SLICE).alias("_slice"))
    order = [F.col("_turn").asc_nulls_last(), F.col("_id")]
    inside = m.withColumn("_prev", F.lag("_id").over(Window.partitionBy("_conv", "_slice").orderBy(*order)))
    last = m.groupBy("_conv", "_slice").agg(F.max(F.struct(F.col("_turn").isNull(), "_turn", "_id")).alias("_last"))
    last = last.select("_conv", "_slice", F.lag("_last._id").over(Window.partitionBy("_conv").orderBy("_slice")).alias("_carry"))
    return inside.join(last, ["_conv", "_slice"]).select("_id", F.coalesce("_prev", "_carry").alias("_prev"))


def conversations(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", least: int = LEAST, origins: int = ORIGINS) -> DataFrame:
    """One row a message: conv_id, turn, role, thread_conv_id, thread_turn, position (from 0, parents first), depth,
    parent_conv_id, parent_turn, link ('quote', 'turn' or 'root'), n_quotes, text (without quotations), formatted."""
    spark = messages.sparkSession
    base = messages.select(
        F.monotonically_increasing_id().alias("_id"),
        messages[conv_col].cast("long").alias("_c"),
        messages[turn_col].cast("long").alias("_turn"),
        F.coalesce(messages[role_col], F.lit("user")).alias("_role"),
        messages[text_col].alias("_text"),
    )
    # a conversation's key; one without conv_id is told by its row
    base = base.withColumn("_conv", F.struct(F.col("_c").isNull().alias("none"), F.coalesce("_c", "_id").alias("id")))
    m = shared.written(passages(base).drop("_text"), "messages")
    place = F.struct("_conv", F.col("_turn").isNull().alias("last"), "_turn", "_id").alias("_place")
    each = m.select(place, "_conv", F.unhex(F.md5(_normal(F.col("_own")))).alias("_said"), F.explode("_passages").alias("p")).select("_place", "_conv", "_said", "p.*")
    said = each.filter("level = 0")
    quoted = shared.written(each.filter("level > 0").drop("_said"), "quoted")
    if quoted.isEmpty():
        parents = None
    else:
        here = said.groupBy("hash", "_conv").agg(F.min("_place").alias("_here"))
        anywhere = said.groupBy("hash", "_said").agg(F.min("_place").alias("_there")).groupBy("hash").agg(F.min("_there").alias("_there"), F.count("*").alias("_origins")).filter(F.col("_origins") <= origins)
        found = quoted.join(here, ["hash", "_conv"], "left").join(anywhere, "hash", "left")
        near = F.when(F.col("_here") < F.col("_place"), F.col("_here"))
        found = found.withColumn("_to", F.coalesce(near, F.when((F.col("_there") < F.col("_place")) & (F.col("n") >= least), F.col("_there")))).filter("_to is not null")
        votes = found.groupBy("_place", "level", "_to").agg(F.sum("n").alias("n"))
        best = votes.groupBy("_place").agg(F.max_by("_to", F.struct(-F.col("level"), "n", (-F.col("_to._id")))).alias("_to"))
        parents = best.select(F.col("_place._id").alias("_id"), F.col("_to._id").alias("_parent"))
    links = m.select("_id", "_conv", "_c", "_turn").join(_previous(m), "_id")
    if parents is None:
        links = links.withColumn("_parent", F.lit(None).cast("long"))
    else:
        links = links.join(parents, "_id", "left")
    links = links.withColumn("link", F.when(F.col("_parent").isNotNull(), "quote").when(F.col("_prev").isNotNull(), "turn").otherwise("root"))
    links = shared.written(links.withColumn("_parent", F.coalesce("_parent", "_prev")).select("_id", "_c", "_turn", "_conv", "_parent", "link"), "links")
    # pointer doubling: _up is _depth steps above, and a root where _done; only those below their root go on
    root = F.col("_parent").isNull()
    up = shared.written(links.select("_id", F.coalesce("_parent", "_id").alias("_up"), F.when(root, 0).otherwise(1).cast("long").alias("_depth"), root.alias("_done")), "roots")
    done, going = up.filter("_done"), up.filter("not _done")
    while not going.isEmpty():
        every = done.unionByName(going)
        top = every.select(F.col("_id").alias("_up"), F.col("_up").alias("_next"), F.col("_depth").alias("_more"), "_done")
        went = shared.written(going.drop("_done").join(top, "_up").select("_id", F.col("_next").alias("_up"), (F.col("_depth") + F.col("_more")).alias("_depth"), "_done"), "roots")
        done, going = done.unionByName(went.filter("_done")), went.filter("not _done")
    up = done.drop("_done")
    rows = links.join(up, "_id").withColumnRenamed("_up", "_root")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["_root", "_depth", "_conv", F.col("_turn").asc_nulls_last(), "_id"]
    rows = shared.written(rows.repartitionByRange(parts, *order).withColumn("_p", F.spark_partition_id()), "ranges")
    rows = rows.withColumn("_at", F.row_number().over(Window.partitionBy("_p").orderBy(*order)).cast("long"))
    sizes = rows.groupBy("_p").agg(F.count("*").alias("n")).collect()  # a row a partition
    starts, total = [], 0
    for p, n in sorted((r["_p"], r.n) for r in sizes):
        starts.append((p, total))
        total += n
    rows = rows.join(F.broadcast(spark.createDataFrame(starts, "_p int, _start long")), "_p").withColumn("_at", F.col("_at") + F.col("_start"))
    first = rows.groupBy("_root").agg(F.min("_at").alias("_first"), F.min_by("_c", "_at").alias("thread_conv_id"), F.min_by("_turn", "_at").alias("thread_turn"))
    rows = rows.join(first, "_root").select("_id", "_parent", "link", F.col("_depth").alias("depth"), (F.col("_at") - F.col("_first")).alias("position"), "thread_conv_id", "thread_turn")
    above = links.select(F.col("_id").alias("_parent"), F.col("_c").alias("parent_conv_id"), F.col("_turn").alias("parent_turn"))
    rows = rows.join(above, "_parent", "left")
    n_quotes = F.size(F.filter("_passages", lambda p: p["level"] > 0)).cast("long")
    return m.join(rows, "_id").select(
        F.col("_c").alias(conv_col), F.col("_turn").alias(turn_col), F.col("_role").alias(role_col), "thread_conv_id", "thread_turn", "position", "depth", "parent_conv_id", "parent_turn", "link",
        n_quotes.alias("n_quotes"), F.col("_own").alias("text"), F.concat(F.lit("<|"), F.col("_role"), F.lit("|>\n"), F.col("_own")).alias("formatted"),
    )


def op8_chat_format(spark, sf_dir: str) -> DataFrame:
    return conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
