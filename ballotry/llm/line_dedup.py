"""Operator 6: fuzzy duplicate lines by MinHash.

All of it is DataFrame functions: no Python runs on the executors. The numpy forms of shingles
and signatures here are what tests hold the native ones against.

Every line that isn't blank is compared, whole, in lower case and with every run of
characters that are neither letters nor digits as one space (a line of other characters
alone is compared as it is, in lower case and trimmed). Its shingles are the five UTF-16
units from each place (a shorter line is one shingle). Two lines are linked when their
sets of shingles have a Jaccard similarity of 0.8 or more. Lines that are equal in that
form are one node from the start, named by a 64-bit hash.

Signature and link use the same shingles. Signatures are made where the folded lines already
are, without another shuffle. A line of many shingles is signed by one order of their hashes, a line
of few by VALUES orders (bucket_keys). Each band has ROWS values. The last bits of a bucket's key are
a sketch of eight values outside its band, three bits each: lines at 0.8 agree in 6.6 of them on
average, unlike lines in 1.3, and only lines that agree in AGREE or more with a line they could be
linked with are compared as texts. Recall by similarity, of both steps together, is in the README.
Buckets have 40-bit keys and five values: enough for some billions of lines, beyond which bands
need more values (unlike lines in a bucket cost time, they don't change results).

Of a bucket each line is verified, on full sets, against one hub, taken by one of three
orders, so that a family of alike lines has several hubs. Union-find (graph.components)
joins the links. In a bucket of several components the lines outside the largest meet all
others in blocks of bounded size: a block is one key of a hash join, whose condition looks at
components, then sketches, then full sets, so that only links between components are rows. Two lines
that share a bucket and agree are either compared on full sets or already in one component. Of each component the
line that comes first, by doc_id and line number, stays.

Defined cases: blank lines stay and have a class of their own each; null or empty text has
one empty line; a row with a null doc_id has no place in the order and stays as it is; rows
that repeat a doc_id are one document, whose equal lines at equal places stay together;
different lines of the same name (a hash collision, noticed by a second hash) stay; an
empty table gives an empty one; other columns aren't looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ballotry.sources.files import Tables

from .common import cut, dealt_by_size, release, shuffles_end
from .graph import blocks, components, packed
from .near_dedup import mix

SHINGLE, THRESHOLD = 5, 80
BANDS, ROWS = 12, 5
VALUES, SKETCHED, BITS, AGREE = BANDS * ROWS, 8, 3, 4
#: Shingles of a line whose values are minima of different orders; lines of more have one order.
FEW = 32
#: Odd numbers without a pattern that turn one hash of a shingle into many.
_ODD = (mix(np.arange(1, VALUES + 1, dtype=np.uint64)) | np.uint64(1)).astype(np.uint32)
#: Constants that make three orders of names.
_XOR = [((i * 0x9E3779B97F4A7C15 + (1 << 63)) % (1 << 64)) - (1 << 63) for i in range(1, 4)]
#: Shingles whose signatures numpy makes at once.
PIECE = 1 << 16


def plain(line: Column | str) -> Column:
    """The form in which lines are compared; empty for blank lines."""
    words = F.trim(F.regexp_replace(F.lower(line), r"[^\p{L}\p{N}]+", " "))
    return once(words, lambda w: F.when(w != "", w).otherwise(F.trim(F.lower(line))))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often use names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def kept_apart(rows: DataFrame, *names: str) -> DataFrame:
    """rows whose named columns are computed here, once, and not wherever they are named."""
    return rows.select(*(c for c in rows.columns if c not in names), F.inline(F.array(F.struct(*names))))


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, line_no, line, node, check) of all lines of rows with an id. Blank lines have
    no name (node) and no second hash (check)."""
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.coalesce(text_col, F.lit("")), "\n", -1)).alias("line_no", "line"))
    told = F.col("line").rlike(r"\S")
    return rows.withColumns({"node": F.when(told, F.xxhash64("line")), "check": F.when(told, F.xxhash64(F.lit(1), "line"))})


_UNITS = 2 * SHINGLE  # bytes of a shingle in UTF-16


def hashes(units: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the SHINGLE units (as uint64) from each place, but the last places."""
    n = len(units) - (SHINGLE - 1)
    h = units[:n] | units[1 : n + 1] << np.uint64(16) | units[2 : n + 2] << np.uint64(32) | units[3 : n + 3] << np.uint64(48)
    return mix(mix(h) + units[4:] * np.uint64(0xD1342543DE82EF95))


def in_units(text: str) -> bytes:
    """A plain line in UTF-16, filled up to a shingle."""
    return text.encode("utf-16-le").ljust(_UNITS, b"\0")


def shingles(text: str) -> np.ndarray:
    """The distinct shingles of a plain line, from its first place to its last, as sorted hashes."""
    return np.unique(hashes(np.frombuffer(in_units(text), "<u2").astype(np.uint64)))


def signatures(texts: list[str]) -> np.ndarray:
    """A column of VALUES values for each plain line."""
    out = np.full((VALUES, len(texts)), np.iinfo(np.uint32).max, np.uint32)
    pieces, owners, held = [], [], 0

    def reduce_pieces() -> None:
        u = np.frombuffer(b"".join(pieces), "<u2").astype(np.uint64)
        places = np.array([len(p) // 2 for p in pieces]) - (SHINGLE - 1)
        whole = np.ones(len(u) - (SHINGLE - 1), bool)  # a shingle that lies in one piece
        ends = np.cumsum(places + (SHINGLE - 1))[:-1]
        for k in range(1, SHINGLE):
            whole[ends - k] = False
        h = (hashes(u) >> np.uint64(32)).astype(np.uint32)[whole]
        first = np.cumsum(places) - places
        for v, odd in enumerate(_ODD):
            out[v, owners] = np.minimum(out[v, owners], np.minimum.reduceat(h * odd, first))

    for i, text in enumerate(texts):
        units = in_units(text)
        for at in range(0, len(units) - _UNITS + 2, 2 * PIECE):
            pieces.append(units[at : at + 2 * PIECE + _UNITS - 2])
            owners.append(i)
            held += len(pieces[-1])
            if held >= 2 * PIECE:  # so no line has two pieces here
                reduce_pieces()
                pieces, owners, held = [], [], 0
    if pieces:
        reduce_pieces()
    return out


def keys_of(values: np.ndarray) -> np.ndarray:
    """A row of keys, one a band, for each column of values: the bucket, and in the last bits a sketch."""
    out = np.empty((values.shape[1], BANDS), np.uint64)
    for b in range(BANDS):
        bucket, sketch = np.full(values.shape[1], b + 1, np.uint64), np.zeros(values.shape[1], np.uint64)
        for v in range(ROWS * b, ROWS * (b + 1)):
            bucket = mix(bucket * np.uint64(0x9E3779B97F4A7C15) + values[v])
        for j in range(SKETCHED):
            v = (ROWS * (b + 1) + j * (ROWS + 1)) % VALUES
            sketch |= (values[v] & np.uint32((1 << BITS) - 1)).astype(np.uint64) << np.uint64(BITS * j)
        out[:, b] = bucket >> np.uint64(BITS * SKETCHED) << np.uint64(BITS * SKETCHED) | sketch
    return out.view(np.int64)


def starts(units: Column | str) -> Column:
    """Where the shingles of a line in UTF-16 begin; a shorter line is one shingle."""
    return F.sequence(F.lit(1), F.greatest(F.octet_length(units) - (_UNITS - 1), F.lit(1)), F.lit(2))


def shingle_hashes(text: Column | str) -> Column:
    """The shingles of a plain line, from its first place to its last, each as an odd 64-bit hash."""
    return once(F.encode(text, "UTF-16LE"), lambda units: F.transform(starts(units), lambda i: F.xxhash64(F.substring(units, i, F.lit(_UNITS))).bitwiseOR(F.lit(1).cast("long"))))


def short_keys(found: Column) -> Column:
    """Keys of a set of few shingle hashes, from VALUES minima, each of another order: the band's
    values are hashed to the bucket, and the last bits are a sketch."""
    low = F.transform(found, lambda h: F.shiftrightunsigned(h, 33))  # 31 bits, whose product with an odd number of 32 bits is a long
    least = once(low, lambda hs: F.transform(F.array(*(F.lit(int(odd)) for odd in _ODD)), lambda odd: F.array_min(F.transform(hs, lambda h: (h * odd).bitwiseAND(F.lit((1 << 32) - 1))))))

    def keys(m: Column) -> Column:
        bits = [[F.shiftleft(m[(ROWS * (b + 1) + j * (ROWS + 1)) % VALUES].bitwiseAND(F.lit((1 << BITS) - 1)), BITS * j) for j in range(SKETCHED)] for b in range(BANDS)]
        return F.array(*(reduce(Column.bitwiseOR, bits[b], F.shiftleft(F.xxhash64(F.lit(-b - 1), *(m[v] for v in range(ROWS * b, ROWS * (b + 1)))), BITS * SKETCHED)) for b in range(BANDS)))

    return once(least, keys)


#: Even numbers at equal distances on the circle of 64-bit numbers; hashes are odd.
_POINTS = [(i << 64) // BANDS // 2 * 2 - (1 << 63) for i in range(BANDS)]


def bucket_keys(lines: DataFrame) -> DataFrame:
    """lines(node, text) -> (node, key): for each band its bucket, and in the last bits a sketch.

    Sets of up to FEW hashes have short_keys(). Larger ones have keys from one order: hashes and points lie on a
    circle, a band has the ROWS hashes behind its point, and the sketch is of what comes first behind
    others. A set of a size between FEW and FEW * 100 / THRESHOLD can be linked with both kinds and has the keys of both."""
    most = ROWS + BANDS - 1  # so many places behind a point hold ROWS hashes
    bits, points, none = F.lit((1 << BITS) - 1), F.array(*map(F.lit, _POINTS)), F.array().cast("array<long>")
    sets = kept_apart(lines.select("node", F.array_distinct(shingle_hashes("text")).alias("found")), "found")
    ring = kept_apart(sets.withColumn("ring", F.sort_array(F.concat("found", points))), "ring")
    ring = kept_apart(ring.withColumn("ring", F.concat("ring", F.slice("ring", 1, most))), "ring")
    place = lambda p: F.array_position("ring", p).cast("int") + 1
    after = [F.shiftleft(F.shiftright(F.get("ring", F.array_position("ring", F.lit(p)).cast("int")), 1).bitwiseAND(bits), BITS * (BANDS - 1 - b)) for b, p in enumerate(_POINTS)]
    once_round = reduce(Column.bitwiseOR, after)
    told = kept_apart(ring.select("node", "found", "ring", F.when(F.size("found") > FEW, once_round).alias("digits")), "digits")
    round_again = F.shiftleft("digits", BITS * SKETCHED).bitwiseOR(F.shiftright("digits", BITS * (BANDS - SKETCHED)))
    told = kept_apart(told.select("node", "found", "ring", round_again.alias("digits"), F.when(F.size("found") * THRESHOLD <= FEW * 100, short_keys(F.col("found"))).otherwise(none).alias("short")), "digits", "short")
    # bands of one order, then those of many
    first, last = F.when(F.size("found") > FEW, 0).otherwise(BANDS), F.when(F.size("short") > 0, 2 * BANDS).otherwise(BANDS) - 1
    rows = told.select("node", "ring", "digits", "short", F.explode(F.sequence(first, last)).alias("b"))
    behind = F.slice(F.array_except(F.slice("ring", place(F.element_at(points, F.col("b") + 1)), most), points), 1, ROWS)
    sketch = F.expr(f"shiftrightunsigned(digits, {BITS} * ({BANDS - 1} - b))").bitwiseAND(F.lit((1 << BITS * SKETCHED) - 1))
    rows = rows.select("node", F.when(F.col("b") < BANDS, F.shiftleft(F.xxhash64("b", behind), BITS * SKETCHED).bitwiseOR(sketch)).otherwise(F.try_element_at("short", F.col("b") - (BANDS - 1))).alias("key"))
    # said to be never null, so that all readers have the same plan and share one shuffle
    return rows.select(*(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in rows.columns))


def agree(x: Column, y: Column) -> Column:
    """Whether two keys' sketches have AGREE values or more in common."""
    differ = x.bitwiseXOR(y)
    some = reduce(Column.bitwiseOR, (F.shiftrightunsigned(differ, i) for i in range(BITS)))
    return F.bit_count(some.bitwiseAND(F.lit(sum(1 << BITS * i for i in range(SKETCHED))))) <= SKETCHED - AGREE


def with_hubs(keys: DataFrame) -> DataFrame:
    """(bucket, node, key, hub, near) of the buckets of several nodes, but for those of two that
    don't agree. The hub is the least name by one of three orders; near: agrees with the hub."""
    bucket = F.shiftright("key", BITS * SKETCHED)
    rows = keys.repartition(bucket).select(bucket.alias("bucket"), "node", "key")  # dealt once, for the hubs and for the join
    order = F.element_at(F.array(*(F.lit(c) for c in _XOR)), (F.pmod("bucket", F.lit(3)) + 1).cast("int"))
    name = F.col("node").bitwiseXOR(order)
    hubs = rows.groupBy("bucket").agg(F.min(name).alias("least"), F.max(name).alias("most"), F.min_by("key", name).alias("low"), F.max_by("key", name).alias("high"), F.count("*").alias("n"))
    hubs = hubs.where("least != most").where((F.col("n") > 2) | agree(F.col("low"), F.col("high")))
    return rows.join(hubs.hint("shuffle_hash"), "bucket").select("bucket", "node", "key", F.col("least").bitwiseXOR(order).alias("hub"), agree(F.col("key"), F.col("low")).alias("near"))


def alike(x: str, y: str) -> Column:
    """Whether two columns of distinct shingle hashes are linked."""
    n, m = F.size(x), F.size(y)
    return (100 * F.least(n, m) >= THRESHOLD * F.greatest(n, m)) & ((100 + THRESHOLD) * F.size(F.array_intersect(x, y)) >= THRESHOLD * (n + m))


def linked(edges: DataFrame, lines: DataFrame) -> DataFrame:
    """The edges(a, b, text of a) whose lines are alike, on full shingle sets. Where lines have hubs, an edge
    that is there the other way round too, as a is among b's hubs, is looked at once, from the lesser end."""
    other = lines.select(F.col("node").alias("b"), F.col("text").alias("b_text"), *(F.col(c) for c in lines.columns if c == "hubs"))
    met_once = (F.col("a") < F.col("b")) | ~F.array_contains("hubs", F.col("a")) if "hubs" in lines.columns else F.lit(True)
    pairs = kept_apart(edges.join(other, "b").where(met_once).select("a", "b", F.array_distinct(shingle_hashes("text")).alias("x"), F.array_distinct(shingle_hashes("b_text")).alias("y")), "x", "y")
    return pairs.where(alike("x", "y")).select("a", "b")


def unsettled(members: DataFrame, parts: DataFrame) -> DataFrame:
    """(group, node, key, component, stray) of the buckets that lie in several components.
    Stray are the nodes outside the bucket's largest."""
    at = members.select(F.shiftright("key", BITS * SKETCHED).alias("group"), "node", "key").join(parts, "node", "left").select("group", "node", "key", F.coalesce("component", "node").alias("component"))
    sizes = at.groupBy("group", "component").agg(F.count("*").alias("n"))
    main = sizes.groupBy("group").agg(F.max(F.struct("n", "component")).alias("top"), F.count("*").alias("parts")).where("parts > 1")
    main = main.where("parts > 2 or top.n > 1")  # a bucket of two has met its hub
    return at.join(main.select("group", F.col("top.component").alias("main")), "group").select("group", "node", "key", "component", (F.col("component") != F.col("main")).alias("stray"))


def met(groups: DataFrame, more: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> tuple[DataFrame, DataFrame, Column]:
    """Members and strays (their columns named with s_) of groups(group, node, key, component, stray, ...) in
    blocks of bounded size, and the condition that joins those to be compared: of one block, in two
    components, with sketches that agree, and of two strays the lesser as the stray. more: adds columns after the shuffle."""
    dealt = blocks(groups.withColumn("lone", F.col("stray")), 256, 1024)
    members, strays = more(dealt.where("not stray")), more(dealt.where("stray"))
    strays = strays.select(*(F.col(c).alias(f"s_{c}") for c in strays.columns))
    same = reduce(Column.__and__, (F.col(c) == F.col(f"s_{c}") for c in ("group", "block", "chunk")))
    return members, strays, same & (F.col("component") != F.col("s_component")) & (~F.col("lone") | (F.col("s_node") < F.col("node"))) & agree(F.col("key"), F.col("s_key"))


def promising(groups: DataFrame) -> DataFrame:
    """groups(group, node, key, component, stray) without the rows whose sketch agrees with none that
    they would be compared with. So texts go only where there may be a link."""
    members, strays, fits = met(groups)
    one = members.join(strays.hint("shuffle_hash"), fits, "left_semi").select("group", "node")
    two = strays.join(members.hint("shuffle_hash"), fits, "left_semi").select(F.col("s_group").alias("group"), F.col("s_node").alias("node"))
    return groups.join(one.union(two).distinct(), ["group", "node"], "left_semi")


def block_links(groups: DataFrame, texts: DataFrame) -> DataFrame:
    """The links (a, b) between components of groups(group, node, key, component, stray), of lines
    that met() brings together, each verified on full shingle sets."""
    members, strays, fits = met(groups.join(texts, "node"), lambda rows: kept_apart(rows.withColumn("set", F.array_distinct(shingle_hashes("text"))).drop("text"), "set"))
    found = members.join(strays.hint("shuffle_hash"), fits & alike("set", "s_set"))
    return found.select(F.least("component", "s_component").alias("a"), F.greatest("component", "s_component").alias("b")).distinct()


def line_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """All lines (doc_id, line_no, node), and of those that are not alone in their
    class (node, keep: the first place of the class, class_size: lines in it)."""
    with shuffles_end(docs.sparkSession), dealt_by_size(docs):
        return _line_classes(docs, id_col, text_col)


def _line_classes(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    every = lines_of(docs, id_col, text_col)
    told = every.where(F.col("node").isNotNull())
    folded = told.groupBy("node").agg(F.first("line").alias("line"), F.min("check").alias("c"), F.max("check").alias("d")).where("c = d")
    at = with_hubs(bucket_keys(folded.select("node", plain("line").alias("text"))))
    at = at.groupBy("node").agg(F.collect_list("key").alias("keys"), F.collect_set(F.when(F.col("near") & (F.col("hub") != F.col("node")), F.col("hub"))).alias("hubs"))
    tables = Tables(docs.sparkSession, "lines")  # compressed, other than a checkpoint
    lines = tables.cut(folded.join(at, "node").select("node", "keys", "hubs", plain("line").alias("text")))
    release(docs.sparkSession)
    texts = lines.select("node", "text")
    edges = lines.select(F.col("node").alias("a"), "text", F.explode("hubs").alias("b"))
    links, _ = packed(linked(edges, lines.select("node", "text", "hubs")))
    parts = cut(components(links, native=True))
    release(docs.sparkSession)
    members, _ = packed(lines.select("node", F.explode("keys").alias("key")))
    groups, _ = packed(unsettled(members, parts))
    groups, _ = packed(promising(groups))
    release(docs.sparkSession)
    more, n = packed(block_links(groups, texts))
    tables.drop_before(tables.count + 1)
    if n:
        merged = cut(components(more, native=True)).select(F.col("node").alias("part"), F.col("component").alias("next"))
        joined = parts.join(merged, F.col("component") == F.col("part"), "left").select("node", F.coalesce("next", "component").alias("component"))
        parts = cut(joined.union(merged.select(F.col("part").alias("node"), F.col("next").alias("component")).join(parts, "node", "left_anti")))
    places = told.groupBy("node").agg(F.min(F.struct("doc_id", "line_no")).alias("keep"), F.count("*").alias("n"), F.min("check").alias("c"), F.max("check").alias("d")).where("c = d")
    places = places.join(parts, "node", "left").where("n > 1 or component is not null").select("node", "keep", "n", F.coalesce("component", "node").alias("component"))
    places, _ = packed(places)
    classes = places.groupBy("component").agg(F.min("keep").alias("keep"), F.sum("n").alias("class_size")).where("class_size > 1")
    found = places.select("node", "component").join(classes, "component").select("node", "keep", "class_size")
    return every.select("doc_id", "line_no", "node"), found


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each line of the rows with an id: doc_id, line_no (from 0), class_size (lines
    of its class), keep_doc_id, keep_line_no (the line that stays), kept."""
    return _places(docs, id_col, text_col).drop("node")


def _places(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of line_dedup with the name of the line, node."""
    every, found = line_classes(docs, id_col, text_col)
    at = every.join(found, "node", "left")
    return at.select(
        F.col("doc_id").alias(id_col), "line_no", F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size"),
        "node", F.coalesce("keep.doc_id", "doc_id").alias("keep_doc_id"), F.coalesce("keep.line_no", "line_no").alias("keep_line_no"),
        F.coalesce((F.col("keep.doc_id") == F.col("doc_id")) & (F.col("keep.line_no") == F.col("line_no")), F.lit(True)).alias("kept"),
    )


def drop_duplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the same columns, without the lines that don't stay; a document that had
    text and has only blank lines left goes."""
    found = _places(docs, id_col, text_col).where("not kept")
    # a name that no column of docs has
    gone = next(name for name in map("gone_{}".format, range(len(docs.columns) + 1)) if name not in docs.columns)
    # by the line too: another row of the same doc_id can have another line at that place
    lost = found.groupBy(id_col).agg(F.collect_set(F.struct("line_no", "node")).alias(gone))
    rest = F.filter(F.split(text_col, "\n", -1), lambda line, i: ~F.array_contains(gone, F.struct(i.alias("line_no"), F.xxhash64(line).alias("node"))))
    at = docs.join(lost, id_col, "left").withColumn(text_col, F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(F.array_join(rest, "\n")))
    return at.where(F.col(gone).isNull() | (F.trim(F.translate(text_col, "\n\r\t", "   ")) != "")).select(*docs.columns)
