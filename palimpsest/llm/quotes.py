"""Quotation linking: reply threads from quoted passages, in DataFrame functions only.

A line's quote level is the number of `>` marks that it begins with (blanks between them are allowed). Consecutive
lines of one level are a passage. Passages are normalised (marks off, lower case, blanks joined) and hashed, whole and
line by line. A quoted passage belongs to the latest earlier message of its conversation that has it as its own (level
0) passage; else (a partial quotation) each of its lines that aren't blank names the latest earlier message that has that
line, and the message that most lines name is taken, the latest of equal ones; failing that, it belongs to the first message of any
other conversation that has it whole, then to the one that most lines name so. A message replies to what its first passage of the lowest quoted level belongs to; without a
linked quotation, to nothing. Clean texts hold the own lines only; a line "On ... wrote:" right before a quotation goes with it.

Replies make threads, across conversations too. A thread is named by the message that it begins with; its reply order is
depth first: a message, then its replies by conversation and turn, each with all below it. Where other conversations reply
to each other in a ring, the smallest message of the ring begins the thread. Threads of any depth are placed by doubling.

Sources of a hash in a conversation are reduced to distinct turns, and the search for the latest one goes by spans of
SPAN turns, so that neither a very common line nor a very long conversation gathers in one task.

Edge cases: null and empty texts have no passages; blank passages are not linked; a null conv_id or turn is never
linked and stands alone; rows that share conv_id and turn are one source, and each gets the links of its own text and
a place below what that replies to, replies to them stand below the one with the smallest hash; equal rows share a place; empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import materialise

#: Turns that are searched together.
SPAN = 1024

MARKS = r"^[ \t]*(>[> \t]*)"
SAID = r"^On .* wrote:\s*$"


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def hashed(text: Column) -> Column:
    return F.unhex(F.md5(normalised(text)))


#: The hash of a blank passage.
BLANK = bytes.fromhex("d41d8cd98f00b204e9800998ecf8427e")


def passages(messages: DataFrame) -> DataFrame:
    """conv, turn, row, clean, own, quotes of messages (conv, turn, row, text).

    own: array of (hash, whole), what the message says itself as whole passages, as its clean text and as lines.
    quotes: array of (level, start, hash, lines: hashes of its lines). Blank passages and lines are in neither.
    """
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    marked = F.transform(lines, lambda x: F.struct(x.alias("line"), F.regexp_extract(x, MARKS, 0).alias("marks")))
    n_marks = lambda m: F.length(m) - F.length(F.replace(m, F.lit(">"), F.lit("")))
    bare = lambda x: x["line"].substr(F.length(x["marks"]) + 1, F.length(x["line"]))
    df = messages.withColumn("marked", marked)
    df = df.withColumn("lines", F.transform("marked", lambda x: F.struct(n_marks(x["marks"]).alias("level"), bare(x).alias("text"), hashed(bare(x)).alias("hash"))))
    every = F.col("lines")
    n = F.size(every)
    said = lambda i: (every[i]["level"] == 0) & (F.coalesce(F.get(every, i + 1)["level"], F.lit(0)) > 0) & every[i]["text"].rlike(SAID)
    at = F.sequence(F.lit(0), n - 1)
    df = df.withColumn("clean", F.array_join(F.transform(F.filter(at, lambda i: (every[i]["level"] == 0) & ~said(i)), lambda i: every[i]["text"]), "\n"))
    df = df.withColumn("starts", F.filter(at, lambda i: (i == 0) | (every[F.greatest(i - 1, F.lit(0))]["level"] != every[i]["level"])))
    s = F.col("starts")
    part = lambda i, j: F.slice(every, i + 1, F.coalesce(F.get(s, j + 1), n) - i)
    df = df.withColumn("pieces", F.transform(s, lambda i, j: F.struct(every[i]["level"].cast("int").alias("level"), i.cast("int").alias("start"), part(i, j).alias("lines"))))
    # A passage of one line has that line's hash.
    whole = lambda p: F.when(F.size(p["lines"]) == 1, p["lines"][0]["hash"]).otherwise(hashed(F.array_join(F.transform(p["lines"], lambda x: x["text"]), " ")))
    named = F.transform("pieces", lambda p: F.struct(p["level"].alias("level"), p["start"].alias("start"), whole(p).alias("hash"), F.array_distinct(F.filter(F.transform(p["lines"], lambda x: x["hash"]), lambda h: h != F.lit(BLANK))).alias("lines")))
    df = df.withColumn("named", F.filter(named, lambda p: p["hash"] != F.lit(BLANK)))
    says = F.filter("named", lambda p: p["level"] == 0)
    wholes = F.filter(F.array_distinct(F.array_append(F.transform(says, lambda p: p["hash"]), hashed(F.col("clean")))), lambda h: h != F.lit(BLANK))
    singles = F.array_distinct(F.flatten(F.transform(says, lambda p: p["lines"])))
    kinds = F.concat(F.transform(wholes, lambda h: F.struct(h.alias("hash"), F.lit(True).alias("whole"))), F.transform(singles, lambda h: F.struct(h.alias("hash"), F.lit(False).alias("whole"))))
    return df.select("conv", "turn", "row", "clean", kinds.alias("own"), F.filter("named", lambda p: p["level"] > 0).alias("quotes"))


def sources(parsed: DataFrame) -> DataFrame:
    """conv, turn, hash, whole: what each message says itself."""
    return parsed.filter("conv is not null and turn is not null").select("conv", "turn", F.explode("own").alias("u")).select("conv", "turn", "u.hash", "u.whole").distinct()


def latest(asked: DataFrame, having: DataFrame) -> DataFrame:
    """asked (conv, turn, hash) with found: the largest smaller turn of having with the same conv and hash."""
    keys = ["conv", "hash"]
    rows = asked.select(*keys, "turn", F.lit(None).cast("long").alias("own")).distinct().unionByName(having.select(*keys, "turn", F.col("turn").alias("own")))
    rows = rows.withColumn("span", F.floor(F.col("turn") / SPAN))
    within = Window.partitionBy(*keys, "span").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    near = rows.withColumn("near", F.max("own").over(within)).filter("own is null").drop("own")
    before = Window.partitionBy(*keys).orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    far = rows.groupBy(*keys, "span").agg(F.max("own").alias("m")).withColumn("far", F.max("m").over(before)).drop("m")
    return near.join(far, [*keys, "span"]).select(*keys, "turn", F.coalesce("near", "far").alias("found"))


def elsewhere(asked: DataFrame, having: DataFrame) -> DataFrame:
    """asked (conv, hash) with any: the first (conv, turn) of having in another conversation with the same hash."""
    asked = asked.distinct()
    one = having.join(asked.select("hash").distinct(), "hash", "left_semi").groupBy("hash", "conv").agg(F.min("turn").alias("turn"))
    # Of each hash the two first conversations are enough.
    rank = F.row_number().over(Window.partitionBy("hash").orderBy("conv"))
    two = one.withColumn("rank", rank).filter("rank <= 2").select("hash", F.struct("conv", "turn").alias("any"))
    return asked.join(two, "hash").filter(F.col("any.conv") != F.col("conv")).groupBy("conv", "hash").agg(F.min("any").alias("any"))


def most(found: DataFrame, quote: list[str], source: list[str], earliest: bool) -> DataFrame:
    """quote, at: the source with the most lines of each quotation; of equal ones the first or the last."""
    counts = found.groupBy(*quote, *source).count()
    sign = -1 if earliest else 1
    best = F.max(F.struct(F.col("count"), *[(F.col(c) * sign).alias(c) for c in source]))
    return counts.groupBy(*quote).agg(best.alias("best")).select(*quote, *[(F.col(f"best.{c}") * sign).alias(c) for c in source])


def link(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Messages (conv, turn, row, clean) and quotations (conv, turn, row, level, start, hash, source_conv, source_turn); row is a hash of the text."""
    parsed = materialise(passages(messages.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(text_col).cast("string").alias("text")).withColumn("row", F.xxhash64("text"))))
    have = materialise(sources(parsed))
    quote, kept = ["conv", "turn", "row", "start"], ["conv", "turn", "row", "level", "start", "hash"]
    quoted = parsed.filter("conv is not null and turn is not null").select("conv", "turn", "row", F.explode("quotes").alias("q")).select("conv", "turn", "row", "q.*").dropDuplicates(quote)
    asks = parsed.select("conv", "turn", F.explode("quotes.hash").alias("hash"))
    near = latest(asks, have.filter("whole")).filter("found is not null")
    first = materialise(quoted.join(near, ["conv", "turn", "hash"], "left"))
    links = [first.filter("found is not null").select(*kept, F.col("conv").alias("source_conv"), F.col("found").alias("source_turn"))]
    # Passages that their conversation doesn't have as a whole go by their lines.
    lines = first.filter("found is null").select(*quote, F.explode("lines").alias("hash"))
    by_line = latest(lines.select("conv", "turn", "hash"), have.filter("not whole")).filter("found is not null")
    picked = most(lines.join(by_line, ["conv", "turn", "hash"]), quote, ["found"], False)
    second = materialise(first.filter("found is null").drop("found").join(picked, quote, "left"))
    links.append(second.filter("found is not null").select(*kept, F.col("conv").alias("source_conv"), F.col("found").alias("source_turn")))
    # What it doesn't have at all is looked up in the corpus.
    lost = materialise(second.filter("found is null"))
    whole, line = (elsewhere(lost.select("conv", h.alias("hash")), have.filter(F.col("whole") == w)) for w, h in ((True, F.col("hash")), (False, F.explode("lines"))))
    lines = lost.select(*quote, F.explode("lines").alias("hash")).join(line, ["conv", "hash"]).select(*quote, F.col("any.conv").alias("source_conv"), F.col("any.turn").alias("source_turn"))
    other = lost.join(whole, ["conv", "hash"], "left").join(most(lines, quote, ["source_conv", "source_turn"], True), quote, "left")
    links.append(other.select(*kept, F.coalesce("any.conv", "source_conv").alias("source_conv"), F.when(F.col("any").isNotNull(), F.col("any.turn")).otherwise(F.col("source_turn")).alias("source_turn")))
    return parsed.select("conv", "turn", "row", "clean"), links[0].unionByName(links[1]).unionByName(links[2])


def without_rings(nodes: DataFrame) -> DataFrame:
    """nodes (id, parent, conv, turn, row, ...); the smallest message of each ring loses its parent.

    Doubling: least is the smallest of the messages that the steps so far come by, which is the own one in a ring's smallest only.
    """
    if not nodes.filter("to_conv > conv").head(1):  # all replies go to smaller messages
        return nodes
    label = F.struct("conv", "turn", "row")
    walk = nodes.filter("parent is not null").select("id", F.col("parent").alias("at"), label.alias("own"))
    walk, steps = materialise(walk.join(nodes.select(F.col("id").alias("at"), label.alias("least")), "at")), 1
    while steps < walk.count():
        ahead = walk.select(F.col("id").alias("at"), F.col("at").alias("next"), F.col("least").alias("more"))
        walk, steps = materialise(walk.join(ahead, "at").select("id", F.col("next").alias("at"), "own", F.least("least", "more").alias("least"))), steps * 2
    first = walk.filter("least = own").select("id", F.lit(True).alias("first"))
    return materialise(nodes.join(first, "id", "left").withColumn("parent", F.when(F.col("first").isNull(), F.col("parent"))).drop("first"))


def placed(nodes: DataFrame) -> DataFrame:
    """id, thread_conv, thread_turn, place (messages of the thread ahead of it) of nodes (id, parent, conv, turn, row, copies).

    Both passes double: what is known of the 2^r nearest messages above or below gives what is known of twice as many.
    """
    # Messages in and below each: every round adds those twice as far below, and only goes on with what lies deeper.
    live, sizes = nodes.filter("parent is not null").select("id", F.col("parent").alias("at"), F.col("copies").alias("size")), nodes.select("id", F.col("copies").alias("size"))
    while live.head(1):
        below = live.groupBy(F.col("at").alias("id")).agg(F.sum("size").alias("more"))
        sizes = sizes.unionByName(below.withColumnRenamed("more", "size"))
        ahead = live.select(F.col("id").alias("at"), F.col("at").alias("next"))
        live = materialise(live.join(ahead, "at").join(below, "id", "left").select("id", F.col("next").alias("at"), (F.col("size") + F.coalesce("more", F.lit(0))).alias("size")))
    # What stands between a message and its parent: replies of the same message that come first, with all below them.
    root = F.col("parent").isNull()
    peers = Window.partitionBy("parent", F.when(root, F.col("conv")), F.when(root, F.col("turn"))).orderBy("conv", "turn", "row").rowsBetween(Window.unboundedPreceding, -1)
    sized = nodes.join(sizes.groupBy("id").agg(F.sum("size").alias("size")), "id").withColumn("step", F.coalesce(F.sum("size").over(peers), F.lit(0)) + F.col("copies"))
    own = materialise(sized.select("id", "parent", "conv", "turn", "copies", "step"))
    state = lambda df, at, top: df.select("id", at.alias("at"), top.alias("top"), "step")
    done = state(own.filter("parent is null"), F.lit(None).cast("long"), F.col("id"))
    live = state(own.filter("parent is not null"), F.col("parent"), F.lit(None).cast("long"))
    while live.head(1):
        ahead = done.unionByName(live).select(F.col("id").alias("at"), F.col("at").alias("next"), F.col("top").alias("above"), F.col("step").alias("more"))
        moved = materialise(live.drop("top").join(ahead, "at").select("id", F.col("next").alias("at"), F.col("above").alias("top"), (F.col("step") + F.col("more")).alias("step")))
        done, live = done.unionByName(moved.filter("at is null")), moved.filter("at is not null")
    tops = own.select(F.col("id").alias("top"), F.col("conv").alias("thread_conv"), F.col("turn").alias("thread_turn"))
    return done.join(own.select("id", "copies"), "id").join(tops, "top").select("id", "thread_conv", "thread_turn", (F.col("step") - F.col("copies")).alias("place"))


def threads(messages: DataFrame) -> DataFrame:
    """conv_id, turn, n_quotes, n_linked, deepest, reply_conv, reply_turn, thread_conv, thread_turn, place, clean: messages without quotes.

    By thread_conv, thread_turn and place they are threads in reply order.
    """
    clean, quotes = link(messages)
    linked = F.col("source_turn").isNotNull()
    per = quotes.groupBy("conv", "turn", "row").agg(
        F.count(F.lit(1)).alias("n_quotes"),
        F.count_if(linked).alias("n_linked"),
        F.max("level").alias("deepest"),
        F.min(F.when(linked, F.struct("level", "start", "source_conv", "source_turn"))).alias("r"),
    )
    keys = ["conv", "turn", "row"]
    told = clean.filter("conv is not null and turn is not null").groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).join(per, keys, "left")
    told = materialise(told.select(*keys, "copies", "n_quotes", "n_linked", "deepest", F.col("r.source_conv").alias("to_conv"), F.col("r.source_turn").alias("to_turn"), F.monotonically_increasing_id().alias("id")))
    source = told.groupBy(F.col("conv").alias("to_conv"), F.col("turn").alias("to_turn")).agg(F.min_by("id", "row").alias("parent"))
    told_by = told.select(*keys, "copies", "id", "to_conv", "to_turn")
    alone = told_by.filter("to_conv is null").withColumn("parent", F.lit(None).cast("long"))  # apart, as nulls would meet in one task
    nodes = materialise(told_by.join(source, ["to_conv", "to_turn"]).unionByName(alone))
    out = clean.join(told.join(placed(without_rings(nodes)), "id"), keys, "left")
    zero = lambda c, t: F.coalesce(F.col(c), F.lit(0)).cast(t).alias(c)
    return out.select(
        F.col("conv").alias("conv_id"), "turn", zero("n_quotes", "long"), zero("n_linked", "long"), zero("deepest", "int"), F.col("to_conv").alias("reply_conv"), F.col("to_turn").alias("reply_turn"),
        F.coalesce("thread_conv", "conv").alias("thread_conv"), F.coalesce("thread_turn", "turn").alias("thread_turn"), zero("place", "long"), "clean",
    )


def quoted(text: Column, marks: str = "> ") -> Column:
    return F.concat(F.lit(marks), F.replace(text, F.lit("\n"), F.lit("\n" + marks)))
