"""Quotation linking: quoted passages are joined to the messages they come from, and conversations are ordered by reply, without quotes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, ranked, stored

#: A line's quote marks, in a form whose matching needs no stack, however many there are.
MARKS = r"^[ \t>]*>"
#: Line that only announces a quotation.
ANNOUNCES = r"^[^\n]{0,200}\b(?:wrote|writes|said|schrieb|a écrit|escribió)[ \t]*:[ \t]*$"
#: Turns of a conversation among which a message looks for the one before it at once, and its order is sorted.
SPAN = 1024
#: Words below which a passage says too little to be linked across conversations.
LEAST_WORDS = 4


def _depth(line: Column) -> Column:
    return F.regexp_count(F.regexp_extract(line, f"({MARKS})", 1), F.lit(">"))


def _bare(line: Column) -> Column:
    return F.btrim(F.regexp_replace(line, MARKS, ""), F.lit(" \t\r\x0b\f"))


def normal(text: Column) -> Column:
    """Lower case, every run of anything but letters and digits one blank."""
    return F.btrim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _lines(text: Column) -> Column:
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.struct(_depth(x).alias("depth"), _bare(x).alias("line")))


def parse_quotes(messages: DataFrame) -> DataFrame:
    """messages with body (own lines, no quotes, no announcing line) and quotes: runs of lines of one level, (level, nth, text) in order."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = _lines(text)

    def own(x: Column) -> Column:
        kept = F.filter(x, lambda v, i: (v["depth"] == 0) & ~(v["line"].rlike(ANNOUNCES) & F.coalesce(F.get(x, i + 1)["depth"] > 0, F.lit(False))))
        return F.btrim(F.array_join(F.transform(kept, lambda v: v["line"]), "\n"), F.lit(" \n\t\r"))

    def runs(x: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(x) - 1), lambda i: (F.get(x, i)["depth"] > 0) & F.coalesce(F.get(x, i - 1)["depth"] != F.get(x, i)["depth"], F.lit(True)))
        ends = F.filter(F.sequence(F.lit(0), F.size(x) - 1), lambda i: (F.get(x, i)["depth"] > 0) & F.coalesce(F.get(x, i + 1)["depth"] != F.get(x, i)["depth"], F.lit(True)))
        return F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda r, n: F.struct(
            F.get(x, r["a"])["depth"].alias("level"), n.alias("nth"), F.array_join(F.transform(F.slice(x, r["a"] + 1, r["b"] - r["a"] + 1), lambda v: v["line"]), "\n").alias("text")))

    quoted = text.rlike(r"(?:^|\n)[ \t]*>")
    none = F.array().cast("array<struct<level:int,nth:int,text:string>>")
    parsed = let(lines, lambda x: F.struct(own(x).alias("body"), runs(x).alias("quotes")))
    whole = F.struct(F.btrim(text, F.lit(" \n\t\r")).alias("body"), none.alias("quotes"))
    return messages.withColumn("_p", F.when(quoted, parsed).otherwise(whole)).withColumn("body", F.col("_p.body")).withColumn("quotes", F.col("_p.quotes")).drop("_p")


def _hash(text: Column) -> Column:
    return F.md5(normal(text).cast("binary"))


def _parts(text: Column) -> Column:
    """Lines and sentences (of each line, and of the whole text whatever lines it is wrapped to), empty ones left out."""
    sentences = lambda x: F.split(x, r"(?<=[.!?\u2026])[\"')\]\u201d\u2019\u00bb]*\s+")
    lines = F.split(text, "\n")
    return F.filter(F.concat(lines, sentences(text), F.flatten(F.transform(lines, sentences))), lambda p: F.length(normal(p)) > 0)


def _units(body: Column) -> Column:
    """Hashes by which a body is found: the whole and each of its lines and sentences, empty ones left out."""
    whole = F.filter(F.array(body), lambda p: F.length(normal(p)) > 0)
    return F.array_distinct(F.transform(F.concat(whole, _parts(body)), _hash))


def _carried(turns: DataFrame, value: Column, name: str, *, own: bool) -> DataFrame:
    """Add the last value that is not null among a conversation's earlier turns (own: this one included).

    Turns are sorted within spans; what a span leaves is carried on in a small table, so a long conversation is no single task.
    """
    spanned = turns.withColumn("_v", value).withColumn("_span", F.floor(F.col("turn") / SPAN))
    rows = Window.partitionBy("conv_id", "_span").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    left = spanned.groupBy("conv_id", "_span").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col("turn"))).alias("_last"))
    before = Window.partitionBy("conv_id").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    left = left.withColumn("_carried", F.last("_last", True).over(before)).drop("_last")
    return spanned.withColumn("_within", F.last("_v", True).over(rows)).join(left, ["conv_id", "_span"]).withColumn(name, F.coalesce("_within", "_carried")).drop("_v", "_span", "_within", "_carried")


def _before(messages: DataFrame) -> DataFrame:
    """conv_id, turn, prev_turn: the turn before."""
    turns = messages.select("conv_id", "turn").where("conv_id is not null and turn is not null").distinct()
    return _carried(turns, F.col("turn"), "prev_turn", own=False)


def link_quotes(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, level, nth, source_conv, source_turn): each quoted passage with the message it comes from, null where none has it.

    A passage is looked up whole, then by its lines and sentences, so parts of a sentence do not link. The first message of the same conversation that holds it, if it is an earlier one, comes before any other, of which
    the first in order of conversation and turn is taken, if what links has LEAST_WORDS words at least: an "ok" says nothing of another conversation. The index holds one row for each hash and conversation and one, with the first two conversations, for each hash, so that
    words said in very many messages link no more rows than they are quoted in.
    """
    parsed = stored(parse_quotes(messages.select("conv_id", "turn", "text").where("conv_id is not null and turn is not null")).select("conv_id", "turn", "body", "quotes"), "quotes")
    passages = parsed.select("conv_id", "turn", F.explode("quotes").alias("q")).select("conv_id", "turn", "q.level", "q.nth", "q.text").distinct()  # rows may repeat
    long_enough = lambda t: (F.size(F.split(normal(t), " ")) >= LEAST_WORDS).alias("far")
    hashes = F.array_distinct(F.concat(F.array(F.struct(F.lit(1).alias("whole"), _hash(F.col("text")).alias("hash"), long_enough(F.col("text")))), F.transform(_parts(F.col("text")), lambda p: F.struct(F.lit(0).alias("whole"), _hash(p).alias("hash"), long_enough(p)))))
    wanted = stored(passages.where(F.length(normal(F.col("text"))) > 0).select("conv_id", "turn", "level", "nth", F.explode(hashes).alias("h")).select("conv_id", "turn", "level", "nth", "h.whole", "h.hash", "h.far"), "wanted")
    index = parsed.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.explode(_units(F.col("body"))).alias("hash")).join(wanted.select("hash").distinct(), "hash", "left_semi")
    index = stored(index.groupBy("hash", "c").agg(F.min("t").alias("t")), "index")
    # the first two conversations of each hash: each task sends two rows of one at most, however many hold it
    two = index.withColumn("_n", F.row_number().over(Window.partitionBy("hash").orderBy("c"))).where("_n <= 2")
    anywhere = two.groupBy("hash").agg(F.min(F.struct("c", "t")).alias("first"), F.max(F.struct("c", "t")).alias("second"))
    near = index.select("hash", F.col("c").alias("conv_id"), F.col("t").alias("near"))
    found = wanted.join(near, ["hash", "conv_id"], "left").join(anywhere, "hash", "left")
    earlier = F.when(F.col("near") < F.col("turn"), F.col("near"))
    other = F.when(F.col("far"), F.when(F.col("first.c") != F.col("conv_id"), F.col("first")).when(F.col("second.c") != F.col("conv_id"), F.col("second")))
    source = F.when(earlier.isNotNull(), F.struct(F.lit(1).alias("near"), F.col("conv_id").alias("c"), earlier.alias("t"))).when(other.isNotNull(), F.struct(F.lit(0).alias("near"), other["c"].alias("c"), other["t"].alias("t")))
    votes = found.withColumn("s", source).where("s is not null").groupBy("conv_id", "turn", "level", "nth", "s").agg(F.max("whole").alias("whole"), F.count("*").alias("n"))
    best = votes.groupBy("conv_id", "turn", "level", "nth").agg(F.max_by("s", F.struct("whole", "s.near", "n", -F.col("s.c"), "s.t")).alias("s"))
    return passages.select("conv_id", "turn", "level", "nth").join(best, ["conv_id", "turn", "level", "nth"], "left").select("conv_id", "turn", "level", "nth", F.col("s.c").alias("source_conv"), F.col("s.t").alias("source_turn"))


def _starts(runs: DataFrame) -> DataFrame:
    """(conv_id, run, start): where each run begins when its conversation is read in reply order, from (conv_id, run, n, parent, to): n turns, branching from the turn
    `to` of the run `parent`, null for the first run.

    A run's turns come one after another, then what branches from it, from its later turns first, earlier branches first. Pointers to
    ancestors double, so sizes and starts take as many rounds as the logarithm of the depth, each written to the shared folder.
    """
    key = ["conv_id", "run"]
    up = stored(runs.select(*key, F.col("parent").alias("up"), F.col("n").alias("size")), "sizes")
    while not up.where("up is not null").isEmpty():
        # size counts the turns of a run and of what hangs below it to a depth that doubles
        below = up.where("up is not null").groupBy("conv_id", F.col("up").alias("run")).agg(F.sum("size").alias("below"))
        above = up.select("conv_id", F.col("run").alias("up"), F.col("up").alias("upper"))
        up = stored(up.join(below, key, "left").join(above, ["conv_id", "up"], "left").select(*key, F.col("upper").alias("up"), (F.col("size") + F.coalesce("below", F.lit(0))).alias("size")), "sizes")
    branches = stored(runs.where("parent is not null").select(*key, "parent", (-F.col("to")).cast("long").alias("place")).join(up.select(*key, "size"), key), "branches")
    # what comes before a branch: that from later turns, and earlier branches from the same turn; both sums are made in spans
    places = stored(branches.groupBy("conv_id", "parent", "place").agg(F.sum("size").alias("size")), "places")
    earlier = ranked(places, ["conv_id", "parent"], ["place"], F.floor(F.col("place") / SPAN), "earlier", F.col("size")).drop("size")
    within = ranked(branches, ["conv_id", "parent", "place"], ["run"], F.floor(F.col("run") / SPAN), "within", F.col("size"))
    local = within.join(earlier, ["conv_id", "parent", "place"]).join(runs.select("conv_id", F.col("run").alias("parent"), F.col("n").alias("of_parent")), ["conv_id", "parent"])
    at = runs.select(*key, F.col("parent").alias("up")).join(local.select(*key, (F.col("of_parent") + F.col("earlier") + F.col("within")).alias("offset")), key, "left")
    at = stored(at.select(*key, "up", F.coalesce("offset", F.lit(0)).cast("long").alias("start")), "starts")
    while not at.where("up is not null").isEmpty():
        above = at.select("conv_id", F.col("run").alias("up"), F.col("up").alias("upper"), F.col("start").alias("more"))
        at = stored(at.join(above, ["conv_id", "up"], "left").select(*key, F.col("upper").alias("up"), (F.col("start") + F.coalesce("more", F.lit(0))).alias("start")), "starts")
    return at.select(*key, "start")


def reply_conversations(messages: DataFrame) -> DataFrame:
    """For every row of messages: conv_id, turn, role, body, n_quotes, n_linked, reply_to, place.

    body is the text without quotes. reply_to: the turn of the same conversation that its first passage of the least level comes from; a
    message without such a link replies to the turn before it. place: its number, from 0, in its conversation when replies follow what they answer,
    earlier ones first. Turns are numbered in spans, so a long conversation is no single task. Null texts are empty; rows of null conv_id or turn have no links and no place; rows repeated
    share theirs; an empty table gives an empty result. Extra columns are not read.
    """
    links = stored(link_quotes(messages), "links")
    counted = links.groupBy("conv_id", "turn").agg(F.count("*").alias("n_quotes"), F.count("source_turn").alias("n_linked"), F.min(F.when(F.col("source_conv") == F.col("conv_id"), F.struct("level", "nth", "source_turn"))).alias("first"))
    tree = stored(_before(messages).join(counted, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", F.coalesce("n_quotes", F.lit(0)).alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"), F.coalesce("first.source_turn", "prev_turn").alias("reply_to"),
        (F.col("first.source_turn").isNotNull() & ~F.col("first.source_turn").eqNullSafe(F.col("prev_turn"))).alias("branches")), "tree")
    # turns that answer the one before are one run, next to each other; only branches need the tree, and there are as many as there are such quotes
    placed = ranked(tree, ["conv_id"], ["turn"], F.floor(F.col("turn") / SPAN), "place")
    if not tree.where("branches").isEmpty():
        homes = stored(_carried(placed, F.when(F.col("branches") | F.col("reply_to").isNull(), F.col("turn")), "run", own=True), "homes")
        jumps = homes.where("branches").select("conv_id", "run", F.col("reply_to").alias("to"))
        parents = jumps.join(homes.select("conv_id", F.col("turn").alias("to"), F.col("run").alias("parent")), ["conv_id", "to"])
        runs = homes.join(jumps.select("conv_id").distinct(), "conv_id", "left_semi").groupBy("conv_id", "run").agg(F.count("*").alias("n"), F.min("place").alias("first"))
        runs = stored(runs.join(parents, ["conv_id", "run"], "left"), "runs")
        moved = _starts(runs).join(runs.select("conv_id", "run", "first"), ["conv_id", "run"]).select("conv_id", "run", (F.col("start") - F.col("first")).alias("moved"))
        placed = homes.join(moved, ["conv_id", "run"], "left").withColumn("place", F.col("place") + F.coalesce("moved", F.lit(0)))
    placed = placed.select("conv_id", "turn", "n_quotes", "n_linked", "reply_to", F.col("place").cast("long").alias("place"))
    bodies = parse_quotes(messages.select("conv_id", "turn", "role", "text")).select("conv_id", "turn", "role", "body")
    return bodies.join(placed, ["conv_id", "turn"], "left").select("conv_id", "turn", "role", "body", F.coalesce("n_quotes", F.lit(0)).cast("long").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), "reply_to", "place")
