"""Chat formatting into token-budgeted windows, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from talentloom.llm.cuts import checked, cut

#: Turn numbers of a block, which is cut into windows by itself, and rows above which a block is parted further.
BLOCK, CROWDED = 1024, 16384
#: Parts of long turns after which a block's next stretch begins.
STRETCH = 1024
#: Bytes that a turn's marks and role may take in a part of a long turn.
HEAD = 128

#: Every control string starts with one of these; in texts and roles they are spelled with a backslash and a letter.
ESCAPES = {"\\": "\\e", "<": "\\l", "[": "\\b", "|": "\\p"}
OPEN, SHUT, END = "<|", "|>", "</s>"
#: Stands where a part of a long turn carries on what the part before began.
ON = "<+>"


def escaped(text: Column) -> Column:
    for plain, spelled in ESCAPES.items():
        text = F.replace(text, F.lit(plain), F.lit(spelled))
    return text


def unescaped(text: Column) -> Column:
    for plain, spelled in reversed(ESCAPES.items()):
        text = F.replace(text, F.lit(spelled), F.lit(plain))
    return text


def _parts(long: Column, room: int) -> Column:
    """An escaped text as parts of at most ``room`` bytes if it is long; no part ends within an escape."""
    ascii_ = F.octet_length("shown") == F.length("shown")
    unit = F.when(~ascii_, 4).when(F.contains("shown", F.lit("\\")), 2).otherwise(1)
    pattern = F.concat(F.lit("(?s).{1,"), F.floor(F.lit(room) / unit).cast("string"), F.lit(r"}(?<!\\)"))
    return F.when(long, F.regexp_extract_all("shown", pattern, F.lit(0))).otherwise(F.array("shown"))


def _cuts(budget: int, history: int, history_turns: int) -> Column:
    """The places (from 1) at which the windows of a stretch begin, and how many turns each repeats: a window is closed by the first turn that its room lacks."""
    no_room = F.lit(2 * budget).cast("long")

    def step(a: Column, x: Column) -> Column:
        repeated, fits, old, sizes = F.lit(0).cast("long"), F.lit(True), F.lit(0), F.lit(0).cast("long")
        for j in range(1, history_turns + 1):
            sizes = sizes + F.coalesce(F.get("sizes", a["at"] - j)["repeats"], no_room)
            fits = fits & (sizes <= history)
            old, repeated = old + fits.cast("int"), F.when(fits, sizes).otherwise(repeated)
        first = a["at"] == 0
        enters = first & (F.col("stretch") == 0)
        room = F.when(enters & F.col("prev").isNull(), F.lit(budget)).otherwise(F.lit(budget) - F.col("system_size") - F.when(enters, F.lit(history)).otherwise(repeated)).cast("long")
        opens = first | (x["size"] > a["left"])
        here = F.struct((a["at"] + 1).alias("at"), old.alias("old"))
        return F.struct((a["at"] + 1).alias("at"), (F.when(opens, room).otherwise(a["left"]) - x["size"]).alias("left"), F.when(opens, F.array_append(a["cuts"], here)).otherwise(a["cuts"]).alias("cuts"))

    start = F.struct(F.lit(0).alias("at"), F.lit(0).cast("long").alias("left"), F.array().cast("array<struct<at:int,old:int>>").alias("cuts"))
    return F.aggregate("sizes", start, step)["cuts"]


def chat_windows(turns: DataFrame, budget: int = 4096, history: int = 512, history_turns: int = 2, tokens: str | None = None) -> DataFrame:
    """Formats conversations (``conv_id, turn, role, text``): ``conv_id, window_id, text, new_from, loss, n_tokens``, a row for each window.

    A turn reads ``<|role|>text</s>``, with control characters escaped so that ``read_turns`` gives role and text back. Its size is the number of its UTF-8 bytes,
    which no byte-level tokenizer exceeds; with ``tokens``, a column with the number of the text's tokens, it is that plus the bytes of the marks.
    Running sums of sizes choose the windows: each takes whole turns in order until the next one does not fit. A window after the first starts with the
    system turn (the conversation's first, if it takes at most a quarter of the budget) and up to ``history_turns`` turns (``history`` in all) that
    precede it. A turn that takes more than the budget without that quarter and the history is split into parts, each with
    marks of its own: ``<+>`` for all but the first. So no window exceeds the budget, as long as roles are short. ``new_from`` is the offset (from 0, in
    code points) of the first new turn; ``loss`` holds start and length of every new assistant text, so that a repeated target never counts twice.
    ``window_id`` orders a conversation's windows.

    ``BLOCK`` turn numbers of a conversation are cut into windows by themselves, so that a long conversation is spread over tasks; blocks that repeated turn
    numbers crowd are parted by ranges of number and hash. Where long turns give a block many parts, ``STRETCH`` of these end a stretch, which is cut by itself too: behind a part
    nothing is repeated, so stretches know nothing of each other, and time grows with a turn's length, not with its square. Texts are shuffled once, by conversation and block; all that follows keeps that partitioning. What a block's
    first window repeats comes from the end of the block before by a join of a few turns for each block.

    Null texts and roles are empty. Rows are ordered by turn (null first), then by a hash of role and text; equal rows are all kept. A null ``conv_id`` is
    a conversation like any other. Other columns are left out; no rows give no windows.
    """
    quarter, piece = budget // 4, budget - budget // 4 - history
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit(OPEN), escaped(role), F.lit(SHUT))
    marks = F.octet_length("head") + len(END)
    rows = turns.select(
        "conv_id", F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("key"), F.col("conv_id").isNull().alias("none"), F.coalesce(F.col("turn").cast("long"), F.lit(-(2**62))).alias("turn"),
        role.alias("role"), F.xxhash64(role, text).alias("hash"), head.alias("head"), escaped(text).alias("shown"), F.least(F.octet_length(text), F.col(tokens) if tokens else F.octet_length(escaped(text))).alias("least"),
    ).withColumn("block", F.floor(F.col("turn") / BLOCK))
    rows = rows.withColumn("size", (marks + (F.least(F.octet_length("shown"), F.col("least")) if tokens else F.octet_length("shown"))).cast("long")).drop("least")

    # blocks that turn numbers crowd are parted by ranges of turn number and hash
    keys = ["key", "none", "block"]
    crowded = cut(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CROWDED).select(*keys, F.ceil(F.col("n") / BLOCK).alias("times")))
    place = F.col("turn") - F.col("block") * BLOCK + F.shiftrightunsigned("hash", 32) / float(2**32)
    rows = rows.join(checked(crowded), keys, "left").withColumn("sub", F.coalesce(F.floor(place * F.col("times")), F.lit(0).cast("long"))).drop("times")

    # parts of long turns are counted in the block's order, so that a stretch of it ends behind so many
    long, keys = F.col("size") > piece, ["key", "none", "block", "sub"]
    rows = rows.withColumn("row", F.when(long, F.monotonically_increasing_id()).otherwise(0)).withColumn("long", long)
    in_block = Window.partitionBy(*keys).orderBy("turn", "hash", "row")
    before, block = in_block.rowsBetween(Window.unboundedPreceding, -1), in_block.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    parted = rows.withColumn("parts", _parts(F.col("long"), piece - HEAD)).drop("shown")
    n_parts = F.when(F.col("long"), F.size("parts")).otherwise(0)
    last = F.floor((F.sum(n_parts).over(block) - F.last("long").over(block).cast("int")) / STRETCH)
    parted = parted.withColumns({"before": F.coalesce(F.sum(n_parts).over(before), F.lit(0).cast("long")), "last_stretch": last})
    pieces = parted.select("*", F.posexplode("parts").alias("part", "shown")).withColumn("stretch", F.floor((F.col("before") + F.col("part")) / STRETCH)).drop("parts", "before")
    pieces = pieces.withColumn("head", F.when(F.col("part") > 0, ON).otherwise(F.col("head"))).withColumn("size", F.when(F.col("long"), (marks + F.octet_length("shown")).cast("long")).otherwise(F.col("size")))

    # slim: a conversation's blocks in order, with its first system turn
    system = rows.filter((F.col("role") == "system")).groupBy("key", "none").agg(F.min(F.struct("turn", "hash", "size", "head", F.when(F.col("size") <= quarter, F.col("shown")).alias("shown"))).alias("system"))
    in_order = Window.partitionBy("key", "none").orderBy("block", "sub")
    neighbour = F.struct("block", "sub")
    blocks = rows.select(*keys).distinct().withColumns({"prev": F.lag(neighbour).over(in_order), "next": F.lead(neighbour).over(in_order)})
    blocks = blocks.join(system, ["key", "none"], "left").withColumn("system", F.when(F.col("system.shown").isNotNull(), F.col("system"))).withColumn("system_size", F.coalesce("system.size", F.lit(0).cast("long")))

    # a stretch's turns with the cuts between its windows
    within = Window.partitionBy(*keys, "stretch").orderBy("turn", "hash", "row", "part")
    whole = within.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    repeats = F.when(F.col("long"), F.lit(2 * budget).cast("long")).otherwise(F.col("size")).alias("repeats")
    placed = (
        pieces.withColumns({"at": F.row_number().over(within), "n": F.count(F.lit(1)).over(whole), "sizes": F.collect_list(F.struct("size", repeats)).over(whole)})
        .withColumn("sizes", F.when(F.col("at") == 1, F.col("sizes")))
        .join(blocks.hint("merge"), keys)
        .withColumn("cuts", F.when(F.col("at") == 1, _cuts(budget, history, history_turns))).drop("sizes")
        .withColumn("cuts", F.first("cuts", ignorenulls=True).over(whole))
    )
    at = F.col("at")
    window = F.size(F.filter("cuts", lambda c: c["at"] <= at))
    behind = F.get("cuts", F.col("window"))  # the next window's cut
    item = lambda new: F.struct(F.lit(new).alias("new"), F.col("at"), F.col("head"), F.col("shown"), F.col("size"), F.col("role"), F.col("turn"), F.col("hash"))
    own = F.struct(F.col("window"), item(True).alias("item"))
    again = F.struct((F.col("window") + 1).alias("window"), item(False).alias("item"))
    windows = (
        placed.withColumn("window", window)
        .select("conv_id", *keys, "stretch", "prev", "system", F.inline(F.when(behind.isNotNull() & (at >= behind["at"] - behind["old"]), F.array(own, again)).otherwise(F.array(own))))
        .groupBy("conv_id", *keys, "stretch", "window").agg(F.first("prev").alias("prev"), F.first("system").alias("system"), F.array_sort(F.collect_list("item")).alias("items"))
    )

    # what a block's first window repeats: the last turns of the block before
    ends = placed.filter(F.col("next").isNotNull() & (F.col("stretch") == F.col("last_stretch")) & (at > F.col("n") - history_turns)).select("key", "none", "next.block", "next.sub", "conv_id", (F.col("n") - at).alias("back"), repeats, item(False).alias("item"))
    last = Window.partitionBy(*keys).orderBy("back").rowsBetween(Window.unboundedPreceding, 0)
    ends = ends.withColumn("used", F.sum("repeats").over(last)).filter(F.col("used") <= history).groupBy(*keys).agg(F.array_sort(F.collect_list("item")).alias("ends"))
    windows = windows.join(ends.hint("merge"), keys, "left").withColumn("items", F.when((F.col("window") == 1) & (F.col("stretch") == 0) & F.col("ends").isNotNull(), F.concat("ends", "items")).otherwise(F.col("items")))

    # the system turn precedes what lies behind it
    first_new = F.get(F.filter("items", lambda x: x["new"]), F.lit(0))
    earlier = F.col("system").isNotNull() & (F.struct("system.turn", "system.hash") < F.struct(first_new["turn"], first_new["hash"]))
    there = F.exists("items", lambda x: (x["turn"] == F.col("system.turn")) & (x["hash"] == F.col("system.hash")))
    carried = F.struct(F.lit(False).alias("new"), F.lit(0).alias("at"), F.col("system.head").alias("head"), F.col("system.shown").alias("shown"), F.col("system.size").alias("size"), F.lit("system").alias("role"), F.col("system.turn").alias("turn"), F.col("system.hash").alias("hash"))
    old = lambda x: ~x["new"]
    windows = windows.withColumn("all", F.concat(F.when(earlier & ~there, F.array(carried)).otherwise(F.array().cast(windows.schema["items"].dataType)), F.filter("items", old), F.filter("items", lambda x: x["new"])))

    length = lambda x: F.length(x["head"]) + F.length(x["shown"]) + len(END)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    step = lambda a, x: F.struct(
        (a["at"] + length(x)).alias("at"),
        F.when(x["new"] & (x["role"] == "assistant"), F.array_append(a["spans"], F.struct((a["at"] + F.length(x["head"])).alias("start"), F.length(x["shown"]).alias("length")))).otherwise(a["spans"]).alias("spans"),
    )
    return windows.select(
        "conv_id",
        F.struct("block", "sub", "stretch", "window").alias("window_id"),
        F.array_join(F.transform("all", lambda x: F.concat(x["head"], x["shown"], F.lit(END))), "").alias("text"),
        F.aggregate(F.filter("all", old), F.lit(0), lambda a, x: a + length(x)).alias("new_from"),
        F.aggregate("all", start, step)["spans"].alias("loss"),
        F.aggregate("all", F.lit(0).cast("long"), lambda a, x: a + x["size"]).alias("n_tokens"),
    )


def read_turns(text: Column) -> Column:
    """The turns of a formatted text, as an array of (role, text); the role is null where a text carries on the turn before."""
    begins = lambda x: F.startswith(x, F.lit(OPEN))
    return F.transform(
        F.filter(F.split(text, END), lambda x: x != ""),
        lambda x: F.struct(
            F.when(begins(x), unescaped(F.substring_index(F.substring(x, 1 + len(OPEN), 2**30), SHUT, 1))).alias("role"),
            unescaped(F.substr(x, F.when(begins(x), F.locate(SHUT, x) + len(SHUT)).otherwise(1 + len(ON)))).alias("text"),
        ),
    )


def digest(windows: DataFrame) -> DataFrame:
    """Per conversation, read back from the windows: turns, and texts under the loss mask. A conversation's new texts come together in one value; what is read from them is not shuffled."""
    moved = F.transform("loss", lambda x: F.struct((x["start"] - F.col("new_from")).alias("start"), x["length"].alias("length")))
    parts = windows.select("conv_id", F.length("text").cast("long").alias("chars"), F.struct("window_id", F.substr("text", F.col("new_from") + 1).alias("text"), moved.alias("loss")).alias("part"))
    whole = parts.groupBy("conv_id").agg(F.sum("chars").alias("formatted_chars"), F.array_sort(F.collect_list("part")).alias("parts"))
    turns = F.flatten(F.transform("parts", lambda p: read_turns(p["text"])))
    said = F.array_join(F.transform("turns", lambda x: F.when(x["role"].isNull(), x["text"]).otherwise(F.concat(F.lit("\n"), x["role"], F.lit("\n"), x["text"]))), "")
    lost = F.flatten(F.transform("parts", lambda p: F.transform(p["loss"], lambda x: unescaped(F.substr(p["text"], x["start"] + 1, x["length"])))))
    whole = whole.select("conv_id", "formatted_chars", turns.alias("turns"), F.array_join(lost, "").alias("lost"))
    return whole.select(
        "conv_id", F.size(F.filter("turns", lambda x: x["role"].isNotNull())).cast("long").alias("n_turns"), F.sha2(F.concat(F.substr(said, F.lit(2)), F.lit("\n")), 256).alias("turns_sha256"),
        F.length("lost").cast("long").alias("loss_chars"), F.sha2("lost", 256).alias("loss_sha256"), "formatted_chars",
    )


#: A conversation that consists of control strings.
PROBE = "SELECT -7L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)"


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return digest(chat_windows(turns.unionByName(spark.sql(PROBE))))
