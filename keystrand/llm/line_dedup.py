"""Line dedup by an exact set-similarity join, in DataFrame functions only.

A line is the set of its words.  A line is removed if an earlier line (smaller doc_id, or same document and earlier place) has a
Jaccard similarity of at least ``SIMILARITY`` with it; lines are judged on the input, so a removed line still removes later ones.

1. Rarity: the corpus' words are counted in ``RARITY`` hash counters (a bounded table whatever the corpus), each reduced to a
   step of a logarithmic scale.  A word's rank is its step, then 56 bits of its hash; ranks in ascending order are the line's
   words from the rarest.  The order is the same in every line, which is all that prefix filtering needs.
2. Lines of equal ranks are equal sets (but for a 56-bit collision between two words in otherwise equal lines).  The first of
   each set is found by a partial aggregation over digests; only it is compared with others, later ones are removed.
3. Each such line posts its rarest words, n - ceil(s * n) + 1 of n.  Lines that share a posted word are partners if their
   lengths, the places of the word in both and maps of their words allow the similarity.  A map has the parity of the words in
   each of 64 classes, 128 for long lines, so maps differ in no more bits than the sets in words, and long lines don't fill them.
4. A line that resembles the first line under one of its six rarest words, or one of the last two before it there, is
   settled by that one alone if many come before it, so a group of near copies costs some pairs a line.  The rest are joined
   with all partners, each pair once, the shorter line against the longer: as the shorter one it needs to post fewer words, a
   ninth of them and one more.
5. The lines of candidate pairs fetch their words again, once for all their pairs, and pairs are verified by the sizes of
   intersection and union.

Null text has no lines; a line without words is never removed; a null doc_id comes first; rows that share a doc_id are told
apart by a digest of their text, and those that also share the text are one document.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keystrand.llm.common import forget, written

SIMILARITY = 0.8
#: Hash counters for words; steps of rarity a power of two has.
RARITY = 1 << 17
STEPS = 3
#: Words above which a line has a map of 128 classes.
LONG = 100
#: The rarest words under which a line is held against the first line and the last few before it, before all others.
LEADERS, BEFORE = 6, 2
#: Lines that must come before it under that word: fewer cost little in the join.
DENSE = 4
#: Bytes of a table that may be broadcast; larger ones are joined by a shuffle.
BROADCAST_BYTES = 20_000_000
BLANKS = "\t\n\x0b\x0c\r"


def spaced(text: Column, blanks: str = BLANKS) -> Column:
    """The text with a space for each other ASCII white space; a plain replacement and split are faster than a pattern."""
    for c in blanks:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return text


def words_of(text: str | Column) -> Column:
    """Words between the six ASCII white spaces."""
    return F.array_remove(F.split(spaced(F.col(text) if isinstance(text, str) else text), " "), "")


def counter_of(hashed: Column) -> Column:
    return hashed.bitwiseAND(F.lit(RARITY - 1)).cast("int")


def rarity_steps(docs: DataFrame) -> Column:
    """The counters' steps, as the high bits of a rank, in a constant array of ``RARITY`` numbers."""
    counts = docs.select(F.explode(F.split("text", f"[ {BLANKS}]")).alias("w")).groupBy(counter_of(F.xxhash64("w")).alias("c")).agg(F.count(F.lit(1)).alias("n"))
    steps = [0] * RARITY
    for c, n in counts.select("c", F.least(F.lit(120), F.floor(STEPS * F.log2("n"))).cast("int")).toLocalIterator():
        steps[c] = n << 56
    return F.split(F.lit(",".join(map(str, steps))), ",").cast("array<bigint>")  # folded into a literal by the optimizer


class Names:
    """Names of lines that compare as the lines come: one long where doc_ids are unique and leave room, else a struct."""

    def __init__(self, docs: DataFrame):
        found = docs.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count(F.lit(1)).alias("n"), F.count("doc_id").alias("ids")).first()
        self.low, self.bits = found["low"] or 0, 31  # bits of a place: no text has 2**31 lines
        whole = (found["high"] or 0) - self.low
        if whole.bit_length() + self.bits > 62:
            self.bits = max(1, ((docs.agg(F.max(F.octet_length("text"))).first()[0] or 0) + 1).bit_length())
        self.long = found["n"] == found["ids"] and whole.bit_length() + self.bits <= 62 and docs.groupBy("doc_id").count().where("count > 1").isEmpty()

    def doc(self) -> Column:
        return F.col("doc_id") if self.long else F.struct("doc_id", F.xxhash64("text").alias("own"))

    def line(self, doc: Column, place: Column) -> Column:
        return F.call_function("shiftleft", doc - self.low, F.lit(self.bits)).bitwiseOR(place.cast("long")) if self.long else F.struct(doc.alias("doc"), place.alias("place"))

    def parts(self, line: str) -> tuple[Column, Column]:
        """(document, place) of a line."""
        c = F.col(line)
        return (F.shiftright(c, self.bits) + self.low, c.bitwiseAND(F.lit((1 << self.bits) - 1)).cast("int")) if self.long else (c["doc"], c["place"])


def lines_of(docs: DataFrame, names: Names) -> DataFrame:
    """Rows (line, t): a line's name and text, with spaces for other blanks."""
    lines = F.split(spaced(F.col("text"), BLANKS.replace("\n", "")), "\n")
    return docs.select(names.doc().alias("doc"), F.posexplode(lines).alias("place", "t")).select(names.line(F.col("doc"), F.col("place")).alias("line"), "t")


def ranked_lines(docs: DataFrame, names: Names) -> DataFrame:
    """Rows (line, n, map, map2, prefix, d1, d2): a line's number of words, maps of all words and of a long line's one half, rarest words and digest of its set."""
    steps, one, last = rarity_steps(docs), F.lit(1).cast("long"), F.lit(63).cast("long")

    def rank(h: Column) -> Column:
        step = F.coalesce(steps[counter_of(h)], F.lit(0).cast("long"))  # never null, so arrays of ranks sort as plain longs
        return step.bitwiseOR(F.shiftrightunsigned(h, 8))

    # A condition on the ranks themselves would be pushed below them and make them twice.
    worded = lines_of(docs, names).where(F.ltrim("t") != "")  # trimming both ends would walk through the whole line
    # What stands within a transform is interpreted, so only hashing and ranking do.
    every = F.transform(F.transform(F.split("t", " "), lambda w: F.xxhash64(w)), rank)
    ranks = F.array_remove(F.array_distinct(every), rank(F.xxhash64(F.lit(""))))  # without the empty parts between two blanks
    lines = worded.select("line", F.sort_array(ranks).alias("ranks"))
    n = F.size("ranks")

    def parity(bit) -> Column:
        return F.aggregate("ranks", F.lit(0).cast("long"), lambda a, r: a.bitwiseXOR(F.call_function("shiftleft", bit(r), r.bitwiseAND(last).cast("int"))))

    half = F.when(n <= LONG, F.lit(0).cast("long")).otherwise(parity(lambda r: F.shiftright(r, 6).bitwiseAND(one)))
    prefix = F.slice("ranks", F.lit(1), (n - F.ceil(n * SIMILARITY - 1e-9) + 1).cast("int"))
    return lines.select("line", n.alias("n"), parity(lambda r: one).alias("map"), half.alias("map2"), prefix.alias("prefix"), F.xxhash64("ranks").alias("d1"), F.xxhash64(F.lit(1), "ranks").alias("d2"))


def later_copies(ranked: DataFrame) -> DataFrame:
    """Rows (line): lines whose set of words an earlier line has."""
    held = ranked.groupBy("d1", "d2").agg(F.min("line").alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1").drop("times")
    return ranked.select("line", "d1", "d2").join(small(written(held, "line-sets")), ["d1", "d2"]).where(F.col("line") > F.col("first")).select("line")


def postings(firsts: DataFrame) -> DataFrame:
    """Rows (key, line, meta, map) of a line's ``LEADERS`` rarest words; meta has the line's size and the word's place, map 64 classes."""
    exploded = firsts.select("line", "n", "map", F.posexplode(F.slice("prefix", 1, LEADERS)).alias("at", "key"))
    return exploded.select("key", "line", (F.col("n").cast("long") * 2**31 + F.col("at") * 2).alias("meta"), "map")


def shortest_overlap(n: Column) -> Column:
    """Words that a line of n shares at least with a similar line that isn't shorter."""
    return F.ceil(n * (2 * SIMILARITY / (1 + SIMILARITY)) - 1e-9)


def searched(firsts: DataFrame, as_shorter: bool) -> DataFrame:
    """Rows (key, line, meta, map, map2) of the words a line posts as the shorter or the longer one of a pair; meta also has the flag ``settled``.

    The shorter one needs fewer: a similar line that isn't shorter holds ``shortest_overlap`` of its words.
    """
    prefix = F.slice("prefix", F.lit(1), (F.col("n") - shortest_overlap(F.col("n")) + 1).cast("int")) if as_shorter else F.col("prefix")
    exploded = firsts.select("line", "n", "map", "map2", F.col("settled").cast("int").alias("low"), F.posexplode(prefix).alias("at", "key"))
    return exploded.select("key", "line", (F.col("n").cast("long") * 2**31 + F.col("at") * 2 + F.col("low")).alias("meta"), "map", "map2")


def may_match(a: str, b: str, whole: bool = True) -> Column:
    """Length, positional and bitmap filters on two postings, whose columns start with ``a`` and ``b``; by both maps if ``whole``."""
    meta_a, meta_b = F.col(a + "meta"), F.col(b + "meta")
    na, nb = (F.shiftright(m, 31) for m in (meta_a, meta_b))
    at, bt = (F.shiftright(m.bitwiseAND(F.lit(2**31 - 1)), 1) for m in (meta_a, meta_b))
    least = least_overlap(na, nb)
    lengths = F.least(na, nb) >= F.greatest(na, nb) * SIMILARITY - 1e-9
    # Similar lines have a first word in common, before which they share none: what follows it must hold the overlap.
    places = F.least(na - at, nb - bt) >= least
    differ = F.bit_count(F.col(a + "map").bitwiseXOR(F.col(b + "map")))
    if whole:  # a long line's other half is what the first adds to the map by XOR
        every, half = (F.col(a + m).bitwiseXOR(F.col(b + m)) for m in ("map", "map2"))
        differ = F.when(F.least(na, nb) > LONG, F.bit_count(every.bitwiseXOR(half)) + F.bit_count(half)).otherwise(differ)
    return lengths & places & (differ <= na + nb - 2 * least)


def least_overlap(na: Column, nb: Column) -> Column:
    return F.ceil((na + nb) * (SIMILARITY / (1 + SIMILARITY)) - 1e-9)


def small(rows: DataFrame, each: Column | None = None) -> DataFrame:
    """A written table, to be broadcast if its rows, ``each`` of so many bytes, have no more than ``BROADCAST_BYTES``."""
    size = rows.agg(F.sum(F.lit(16 * len(rows.columns)) if each is None else each)).first()[0] or 0
    return F.broadcast(rows) if size <= BROADCAST_BYTES else rows


def words_of_lines(pairs: DataFrame, docs: DataFrame, names: Names) -> DataFrame:
    """Rows (line, w): the 64-bit hashes of the different words of the lines in pairs (earlier, later)."""
    doc, place = names.parts("line")
    wanted = pairs.select(F.explode(F.array("earlier", "later")).alias("line")).distinct().select(doc.alias("doc"), place.alias("place"))
    wanted = small(written(wanted.groupBy("doc").agg(F.collect_list("place").alias("places")), "lines-wanted"), 32 + 4 * F.size("places"))
    split = docs.select(names.doc().alias("doc"), "text").join(wanted, "doc").select("doc", "places", F.split("text", "\n").alias("lines"))
    held = split.select("doc", F.explode(F.transform("places", lambda k: F.struct(k.alias("place"), F.get("lines", k).alias("t")))).alias("own"))
    hashes = F.array_distinct(F.transform(words_of(F.col("own.t")), lambda w: F.xxhash64(w)))
    return written(held.select(names.line(F.col("doc"), F.col("own.place")).alias("line"), hashes.alias("w")), "line-words")


def similar(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """Rows (line): those whose earlier partner in a pair is similar enough."""
    a, b = words.select(F.col("line").alias("earlier"), F.col("w").alias("wa")), words.select(F.col("line").alias("later"), F.col("w").alias("wb"))
    both = pairs.join(a, "earlier").join(b, "later")
    same = F.size(F.array_intersect("wa", "wb"))
    return written(both.where(same >= (F.size("wa") + F.size("wb") - same) * SIMILARITY - 1e-9).select(F.col("later").alias("line")).distinct(), "lines-verified")


def verified(pairs: DataFrame, docs: DataFrame, names: Names) -> DataFrame:
    """Rows (line): those with a similar enough partner in written pairs; a line's other partners are tried only if the earliest fails."""
    words = words_of_lines(pairs, docs, names)
    sure = similar(pairs.groupBy("later").agg(F.min("earlier").alias("earlier")), words)
    rest = pairs.join(sure.withColumnRenamed("line", "later"), "later", "left_anti")
    found = sure.unionByName(similar(rest, words))
    forget(words)  # the largest table here, before the next shuffle
    return found


def removed_lines(docs: DataFrame, names: Names) -> DataFrame:
    """Rows (line)."""
    docs = docs if names.long else docs.dropDuplicates(["doc_id", "text"])
    ranked = written(ranked_lines(docs, names), "ranked-lines", {"parquet.enable.dictionary": "false"})
    again = written(later_copies(ranked), "lines-again")
    firsts = ranked.join(small(again), "line", "left_anti").select("line", "n", "map", "map2", "prefix")
    order = Window.partitionBy("key").orderBy("line")
    posted = ("line", "meta", "map")
    rows = postings(firsts)
    seen = {f"p{k}_{c}": (F.lag(c, k).over(order) if k else F.first(c).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))) for k in range(BEFORE + 1) for c in posted}
    led = rows.select(*posted, *[c.alias(name) for name, c in seen.items()], F.lag("line", DENSE).over(order).alias("many")).where("many is not null")
    earlier = [F.when((F.col(f"p{k}_line") < F.col("line")) & may_match(f"p{k}_", "", whole=False), F.col(f"p{k}_line")) for k in range(BEFORE + 1)]
    near = led.select(F.explode(F.array(*earlier)).alias("earlier"), F.col("line").alias("later")).where("earlier is not null")
    settled = verified(written(near.distinct(), "line-partners"), docs, names)
    flagged = firsts.join(small(settled).withColumn("settled", F.lit(True)), "line", "left").withColumn("settled", F.coalesce("settled", F.lit(False)))
    a, b = searched(flagged, True).alias("a"), searched(flagged, False).alias("b")
    na, nb = F.shiftright("a.meta", 31), F.shiftright("b.meta", 31)
    before = F.col("a.line") < F.col("b.line")
    # Of equal lengths, the earlier line takes the part of the shorter one, so each pair meets in one order only.
    shorter = (na < nb) | ((na == nb) & before)
    open_ = F.when(before, F.col("b.meta")).otherwise(F.col("a.meta")).bitwiseAND(F.lit(1)) == 0  # a settled line needs no earlier partner
    pairs = a.join(b, "key").where(shorter & may_match("a.", "b.") & open_)
    pairs = written(pairs.select(F.least("a.line", "b.line").alias("earlier"), F.greatest("a.line", "b.line").alias("later")).distinct(), "line-partners")
    late = verified(pairs, docs, names)
    return again.unionByName(settled).unionByName(late)


def dedup_lines(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows (doc_id, text, n_lines, n_removed, *carry): the text of the lines that stay, joined by newlines."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *[F.col(c).alias(f"carry{k}") for k, c in enumerate(carry)])
    names = Names(docs)
    doc, place = names.parts("line")
    gone = removed_lines(docs.select("doc_id", "text"), names).select(doc.alias("doc"), place.alias("place")).groupBy("doc").agg(F.collect_set("place").alias("places"))
    joined = docs.withColumn("doc", names.doc()).join(small(written(gone, "gone-lines"), 32 + 4 * F.size("places")), "doc", "left").withColumn("lines", F.when(F.col("places").isNotNull(), F.split("text", "\n")))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "places"), lambda k: F.get("lines", k))
    text = F.when(F.col("places").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    n_lines = F.coalesce(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long")
    n_removed = F.coalesce(F.size("places"), F.lit(0)).cast("long")
    return joined.select("doc_id", text.alias("text"), n_lines.alias("n_lines"), n_removed.alias("n_removed"), *[F.col(f"carry{k}").alias(c) for k, c in enumerate(carry)])
