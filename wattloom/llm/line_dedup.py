"""Line dedup by a deletion-neighbourhood join, with built-in functions only.

Lines are compared trimmed, lower-cased and with runs of white space as one space. A line is
removed if an earlier line of the corpus (by doc_id, then place in the text) is the same or within
`bound` edits (insertion, deletion or substitution of a character). Blank lines stay and are not
compared; all others are, whatever their length.

1. Exact copies: every distinct line is represented by its earliest place. Lines are known by two
   64-bit hashes, so no text is shuffled here, and copies are merged before the shuffle.
2. Which lines can have a neighbour at all: cut the shorter of two lines within `bound` edits into
   bound + 1 pieces, and one of them stands in the other, moved by at most `bound` characters (by pieces
   that end a line, for a bound of 1, by none). Lines that share such a piece with another distinct line go on.
   Where at most FEW lines share it, each two of them are a pair, at most FEW / 2 of them per line.
3. Deletion neighbourhood: each line that shares a piece with more emits itself and all its variants with up to
   `bound` characters left out, as hashed keys. (Two lines in reach of each other that share no piece of few lines are both among these.) Lines with equal variants and equal places left out are all as near as their
   earliest is, so that one stands for them and no pairs are made within such a group.
   For a bound of 1, lines are first compared by all that lies before and behind a window of `window`
   characters; again, few that agree in it are pairs, and only where more do, variants of the window are made.
   So long lines cost little more than short ones. For more, variants of whole lines are made; their number
   grows as the length to the power of the bound.
4. Those pairs are verified with levenshtein(), the later line of each goes, and the lines that
   remain are kept where they came first.

Nulls: a null text stays null; rows without doc_id come after all others. Rows with the same doc_id
and text are the same place: their lines are kept or removed together. Texts with the same doc_id
that differ are ordered by hash. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NO_ID, write_table

GAPS = r"[\x20\x09\x0B-\x0D]+"
#: So many lines (48 bytes each) that share a piece with another may be broadcast; more are joined by a shuffle.
SMALL = 200_000
#: A piece that a thousandth of all lines and at least so many have is looked up by broadcast (there are at most 1000 times the pieces of a line).
HOT = 1000
#: Lines with the same piece are compared two by two if they are so many or fewer.
FEW = 16


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _normal(text: Column) -> Column:
    """A text or line in lower case, with one space for each run of white space; line breaks stay. Lines of it still are to be trimmed."""
    text = F.lower(text)
    odd = text.contains("  ")
    for gap in "\t\r\x0b\x0c":
        odd = odd | text.contains(gap)
    return F.when(odd, F.regexp_replace(text, GAPS, " ")).otherwise(text)


def _place(docs: DataFrame) -> DataFrame:
    """(_id, _text): what identifies a document, in the order that decides which line is earlier."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_id"), F.xxhash64("text").alias("_hash"), "text")


def _occurrences(docs: DataFrame) -> DataFrame:
    """One row per line that takes part: id1, id2 (its hashes), at (its place), line."""
    rows = _place(docs).select("_id", "_hash", F.posexplode(_lines(_normal(F.col("text")))).alias("_no", "line")).withColumn("line", F.trim("line")).where("line <> ''")
    return rows.select(*_names(), F.struct("_id", "_hash", "_no").alias("at"), "line")


def _names() -> list[Column]:
    return [F.xxhash64("line").alias("id1"), F.xxhash64(F.lit(1), "line").alias("id2")]


def _pieces(bound: int) -> list[Column]:
    """Keys (or null) of the pieces of a line as the shorter of two, and of what may match them as the longer: columns, which cost far less here than an array that is filtered.

    A key tells the length of the shorter line, so pieces of lines of other lengths do not meet.
    """
    keys = []
    for less in range(bound + 1):
        n = f"(length(line) - {less})"
        for j in range(bound + 1):
            start, end = f"({n} * {j} div {bound + 1})", f"({n} * {j + 1} div {bound + 1})"
            moves = [0] if j == 0 and bound == 1 else [less] if bound == 1 else range(-bound, bound + 1) if less or bound > 1 else [0]
            for m in moves:
                key = f"xxhash64({n}, {j}, substring(line, {start} + {m} + 1, {end} - {start}))"
                keys.append(key if bound == 1 else f"if({start} + {m} >= 0, {key}, null)")
    return [F.expr(key).alias(f"piece{k}") for k, key in enumerate(keys)]


def _windows(texts: DataFrame, window: int) -> DataFrame:
    """Per window of a line, as the shorter of two (less = 0) and as the longer or one of equals (1): here, its characters, and piece, a key of what lies before and behind it and of the shorter's length."""
    w = window
    rows = texts.select("at", "id1", "id2", "line", F.explode(F.array(F.lit(0), F.lit(1))).alias("less"))
    rows = rows.select("*", F.explode(F.expr(f"sequence(0, int(greatest(length(line) - less - 1, 0) div {w}))")).alias("c"))
    piece = F.expr(f"xxhash64(length(line) - less, c, xxhash64(substring(line, 1, c * {w})), xxhash64(substring(line, (c + 1) * {w} + 1 + less)))")
    return rows.select("at", "id1", "id2", "less", F.expr(f"substring(line, c * {w} + 1, {w} + less)").alias("here"), piece.alias("piece"))


def _variants(windows: DataFrame) -> DataFrame:
    """(key, gap) of the windows of shorter lines, and of longer ones with one character left out; gap: its place in the window, null for the shorter."""
    rows = windows.select("at", "id1", "id2", "piece", "here", F.explode(F.expr("if(less = 0, array(int(null)), sequence(0, length(here) - 1))")).alias("gap"))
    left = F.expr("if(gap is null, here, concat(substring(here, 1, gap), substring(here, gap + 2)))")
    return rows.select("at", "id1", "id2", F.xxhash64("piece", left).alias("key"), "gap")


def _whole_variants(bound: int) -> Column:
    """(key, gaps) of a line and its variants with up to `bound` characters left out; gaps: their places."""
    steps = ["array(named_struct('text', line, 'at', 0, 'gaps', ''))"]
    for _ in range(bound):
        steps.append(f"""flatten(transform({steps[-1]}, v -> transform(filter(sequence(0, length(v.text)), i -> i >= v.at and i < length(v.text)), i -> named_struct(
            'text', concat(substring(v.text, 1, i), substring(v.text, i + 2)), 'at', i, 'gaps', concat(v.gaps, ' ', string(i))))))""")
    return F.transform(F.expr(f"concat({', '.join(steps)})"), lambda v: F.struct(F.xxhash64(v["text"]).alias("key"), v["gaps"].alias("gaps")))


def _partners_of_one(texts: DataFrame, window: int) -> DataFrame:
    """(id1, id2, other1, other2): lines that agree outside a window, if few do, else lines and earlier ones that a variant with one character left out joins."""
    windows = write_table(_windows(texts, window), "line-windows")
    met = write_table(_meetings(windows, windows.count()), "windows-met")
    variants = _variants(met.where("not few"))
    me, by_key = F.struct("at", "id1", "id2"), Window.partitionBy("key")
    own = variants.withColumn("_line", me).withColumns({
        "_same": F.min("_line").over(Window.partitionBy("key", "gap")),
        "_whole": F.min(F.when(F.col("gap").isNull(), F.col("_line"))).over(by_key),
        "_less": F.min(F.when(F.col("gap").isNotNull(), F.col("_line"))).over(by_key),
    })
    partners = F.filter(F.array(F.when(F.col("gap").isNotNull(), F.col("_same")), F.when(F.col("gap").isNotNull(), F.col("_whole")), F.when(F.col("gap").isNull(), F.col("_less"))), lambda p: p.isNotNull() & (p < F.col("_line")))
    crowded = own.select("id1", "id2", F.explode(partners).alias("_other")).select("id1", "id2", F.col("_other.id1").alias("other1"), F.col("_other.id2").alias("other2")).distinct()
    return crowded.unionByName(_pairs_of_few(met))


def _partners(texts: DataFrame, bound: int) -> DataFrame:
    """The same for any bound: a key has at most as many groups as a line has sets of places to leave out."""
    variants = texts.select(F.struct("at", "id1", "id2").alias("_line"), F.explode(_whole_variants(bound)).alias("v")).select("_line", "v.*")
    firsts = variants.groupBy("key", "gaps").agg(F.min("_line").alias("_first")).drop("gaps").distinct()
    met = variants.select("_line", "key").distinct().join(firsts, "key").where("_first < _line")
    return met.select("_line.id1", "_line.id2", F.col("_first.id1").alias("other1"), F.col("_first.id2").alias("other2")).distinct()


def _pieces_of(firsts: DataFrame) -> DataFrame:
    pieces = F.array_distinct(F.array(*[c for c in firsts.columns if c.startswith("piece")]))
    return firsts.select("id1", "id2", F.explode(pieces).alias("piece")).where("piece is not null")


def _meetings(keys: DataFrame, n: int) -> DataFrame:
    """The rows of keys (n lines or windows) whose piece another line has, too; few: whether at most FEW rows have it."""
    shared = keys.groupBy("piece").agg(F.min("id1").alias("_a"), F.max("id1").alias("_b"), F.count(F.lit(1)).alias("_n")).where("_a <> _b").select("piece", "_n")
    shared = write_table(shared, "shared-pieces")
    often = [r.piece for r in shared.where(F.col("_n") >= max(HOT, FEW + 1, n / 1000)).select("piece").collect()]
    some = F.col("piece").isin(often) if often else F.lit(False)
    rest = keys.where(~some).join(shared.where(~some), "piece").select(*keys.columns, (F.col("_n") <= FEW).alias("few"))
    return rest.unionByName(keys.where(some).withColumn("few", F.lit(False)))


def _pairs_of_few(met: DataFrame) -> DataFrame:
    """(id1, id2, other1, other2): each two lines with the same piece, where few have it."""
    one = met.where("few").select("piece", "id1", "id2")
    other = one.select("piece", F.col("id1").alias("other1"), F.col("id2").alias("other2"))
    return one.join(other, "piece").where("id1 < other1 or id1 = other1 and id2 < other2").select("id1", "id2", "other1", "other2").distinct()


def kept_lines(docs: DataFrame, bound: int = 1, window: int = 64) -> DataFrame:
    """(_id, _hash, keep): per document the places of the lines that stay, blank ones apart."""
    found = _occurrences(docs).select("id1", "id2", "at", *_pieces(bound))
    firsts = write_table(found.groupBy("id1", "id2").agg(F.min("at").alias("at"), *[F.first(c).alias(c) for c in found.columns[3:]]), "lines")
    met = write_table(_meetings(_pieces_of(firsts), firsts.count()), "lines-met")
    near = met.groupBy("id1", "id2").agg((~F.min("few")).alias("crowded"))
    near = write_table(near.join(firsts.select("id1", "id2", "at"), ["id1", "id2"]), "lines-near")
    places = near.groupBy("at._id", "at._hash").agg(F.collect_list("at._no").alias("_nos"))
    if near.count() <= SMALL:
        places = F.broadcast(places)
    rows = _place(docs).join(places, ["_id", "_hash"]).withColumn("_all", _lines(F.col("text")))
    rows = rows.select("_id", "_hash", F.explode("_nos").alias("_no"), "_all").withColumn("line", F.trim(_normal(F.expr("_all[_no]"))))
    texts = rows.select(*_names(), F.struct("_id", "_hash", "_no").alias("at"), "line")
    texts = write_table(texts.groupBy("id1", "id2").agg(F.min("at").alias("at"), F.first("line").alias("line")), "line-texts")
    crowd = texts.join(near.where("crowded").select("id1", "id2"), ["id1", "id2"], "left_semi")
    pairs = _pairs_of_few(met).unionByName(_partners_of_one(crowd, window) if bound == 1 else _partners(crowd, bound))
    one, other = texts.select("id1", "id2", "at", "line"), texts.select(*[F.col(c).alias(x) for c, x in (("id1", "other1"), ("id2", "other2"), ("at", "_at"), ("line", "_line"))])
    checked = pairs.join(one, ["id1", "id2"]).join(other, ["other1", "other2"]).where(F.levenshtein("line", "_line", bound) >= 0)
    later = F.when(F.col("at") > F.col("_at"), F.struct("id1", "id2")).otherwise(F.struct(F.col("other1").alias("id1"), F.col("other2").alias("id2")))
    stay = firsts.select("id1", "id2", "at").join(checked.select(later.alias("_later")).select("_later.*").distinct(), ["id1", "id2"], "left_anti")
    return stay.groupBy("at._id", "at._hash").agg(F.collect_list("at._no").alias("keep"))


def _flags(places: str) -> Column:
    """For an array of places, one with true at each and false before and between them: looked up by place, so long texts take time in proportion."""
    ordered = F.sort_array(F.array_distinct(F.coalesce(places, F.array().cast("array<int>"))))
    gaps = F.zip_with(ordered, F.concat(F.array(F.lit(-1)), ordered), lambda here, before: F.when(here.isNotNull(), F.concat(F.array_repeat(F.lit(False), here - before - 1), F.array(F.lit(True)))).otherwise(F.array().cast("array<boolean>")))
    return F.flatten(gaps)


def dedup_lines(docs: DataFrame, bound: int = 1, window: int = 64) -> DataFrame:
    """docs with the text that is left, and n_lines and n_removed of each document (in place of columns of these names)."""
    keep = write_table(kept_lines(docs.select("doc_id", "text"), bound, window).toDF("_dl_id", "_dl_hash", "_dl_keep"), "kept-lines")
    rows = docs.withColumns({"_dl_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), "_dl_hash": F.xxhash64("text")}).join(keep, ["_dl_id", "_dl_hash"], "left")
    rows = rows.withColumns({"_dl_lines": _lines(F.col("text")), "_dl_keep": _flags("_dl_keep")})
    blank = lambda x: F.btrim(x, F.lit(" \t\n\x0b\f\r")) == ""
    rows = rows.withColumn("_dl_left", F.filter("_dl_lines", lambda x, i: F.coalesce(F.get("_dl_keep", i), F.lit(False)) | blank(x)))
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size("_dl_lines"))
    left = F.when(F.col("text").isNull(), 0).otherwise(F.size("_dl_left"))
    own = {"text": F.array_join("_dl_left", "\n").alias("text")}
    return rows.select(*[own.get(c, F.col(c)) for c in docs.columns if c not in ("n_lines", "n_removed")], n.alias("n_lines"), (n - left).alias("n_removed"))
