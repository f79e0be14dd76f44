"""Near-duplicate classes by an inverted join on MinHash signature coordinates.

1. Each text's set of word shingles gives a signature of COORDINATES minima. Texts with the same set are one class from
   the start; only its smallest doc_id goes on.
2. A pair at the similarity threshold agrees in at least `matches_needed` coordinates, but for a chance of 1e-9 or
   less. So the task is: which signatures share that many (coordinate, value) pairs. Signatures are posted under each
   pair; values that only one signature has are dropped, and so is a signature with too few others left (it can't
   reach the count). Of the rest, ordered from rare to frequent, all but matches_needed - 1 form its prefix: two
   signatures that reach the count share a member of both prefixes. The long lists of values that many texts share
   (boilerplate) come last in the order and are skipped.
3. Lists are not expanded into pairs. In rounds, each signature on a list is compared with the list's hub only: the most
   typical one first, then one chosen by a hash. Coordinates that agree are counted, pairs with enough are confirmed
   on the full sets, and confirmed links are merged into components. A list whose members are all in one component is
   done. The members of lists that are still open are put together by the lists' most typical hub, so that lists of
   one family count once, and those outside a family's largest component meet all of the family's in cells of bounded
   size. There too, collisions of signatures are counted, with the same prefix and skipping, and pairs with enough are
   confirmed; out of a cell come at most as many links as join its components. So no link between components is lost.

Components come from label propagation with pointer jumping over tables; links and components stay distributed.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docbasin.llm.common import among, arrow, hash_words, mix, pieces, read, stored, words

COORDINATES = 64
HUB_ROUNDS = 2
#: Bytes of sets and signatures on either side of a cell, and up to which a family is small: small ones share a task.
CELL_BYTES, SMALL_BYTES = 1 << 20, 256 << 10
#: Words of a bitmap of ids (each of up to 64 ids that lie close) up to which it is broadcast; beyond, ids are shuffled.
BROADCAST_IDS = 250_000
#: Parts that the members of one family are dealt by before they meet its figures.
SALTS = 64


def matches_needed(threshold: float, coordinates: int = COORDINATES, miss: float = 1e-9) -> int:
    """The largest count that a pair at the threshold falls short of with a chance of at most `miss`."""
    tail, k = 0.0, 0
    while k < coordinates:
        tail += comb(coordinates, k) * threshold**k * (1 - threshold) ** (coordinates - k)
        if tail > miss:
            break
        k += 1
    return max(1, k)


def shingles(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles per text and their hashes, distinct and sorted in each text. Fewer words than `size` make one shingle."""
    per, index, dictionary = words(texts)
    h = hash_words(dictionary)[index] if len(index) else np.zeros(0, np.uint64)
    factors = mix(np.arange(1, size + 1, dtype=np.uint64)) | np.uint64(1)
    n = len(h)
    begin = np.cumsum(per) - per
    value = np.zeros(n, np.uint64)
    doc = np.repeat(np.arange(len(per)), per)
    left = np.repeat(begin + per, per) - np.arange(n)  # words from here to the text's end
    for i in range(min(size, n)):
        part = h[i:] * factors[i]
        value[: n - i] += np.where(left[: n - i] > i, part, np.uint64(0))
    short = per[doc] < size if n else np.zeros(0, bool)
    at_begin = np.zeros(n, bool)
    at_begin[begin[per > 0]] = True
    keep = (left >= size) | (short & at_begin)
    value = mix(value + np.where(short, per[doc].astype(np.uint64), np.uint64(0)) if n else value)[keep]
    doc = doc[keep]
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    value, doc = value[fresh], doc[fresh]
    return np.bincount(doc, minlength=len(per)), value


def signatures(docs: DataFrame, size: int, coordinates: int = COORDINATES) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_shingles, key1, key2 (128 bits of the set), tokens (a hash of each coordinate and its minimum)."""
    seeds = mix(np.arange(1000, 1000 + coordinates, dtype=np.uint64)) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            per, value = shingles(piece["text"], size)
            some = per > 0
            begin = (np.cumsum(per) - per)[some]
            keys = np.zeros((2, len(per)), np.uint64)
            tokens = np.zeros((int(some.sum()), coordinates), np.uint64)
            if len(value):
                for k in range(2):
                    keys[k, some] = np.add.reduceat(mix(value + np.uint64(k + 1)), begin)
                for j in range(coordinates):
                    tokens[:, j] = mix(np.minimum.reduceat(value * seeds[j], begin) + np.uint64(j))
            rows = np.cumsum(np.concatenate([[0], np.where(some, coordinates, 0)])).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(rows), pa.array(tokens.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([piece["doc_id"].cast(pa.int64()), pa.array(per.astype(np.int64)), pa.array(keys[0].view(np.int64)), pa.array(keys[1].view(np.int64)), lists], names=["doc_id", "n_shingles", "key1", "key2", "tokens"])

    return arrow(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, n_shingles long, key1 long, key2 long, tokens array<long>")


def sets(docs: DataFrame, size: int) -> DataFrame:
    """docs (doc_id, text) -> id, shingle_set (the shingles' sorted 64-bit hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            per, value = shingles(piece["text"], size)
            packed, ends = value.tobytes(), np.cumsum(per) * 8
            own = [packed[b:e] for b, e in zip(ends - per * 8, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([piece["doc_id"].cast(pa.int64()), pa.array(own, pa.binary())], names=["id", "shingle_set"])

    return arrow(docs.select("doc_id", "text")).mapInArrow(run, "id long, shingle_set binary")


def _unpacked(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, np.uint64)


def confirmed(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) with 100 * intersection >= percent * union of their full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "set_a"):
            ok = []
            for x, y in zip(piece["set_a"].to_pylist(), piece["set_b"].to_pylist(), strict=True):
                x, y = _unpacked(x), _unpacked(y)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                both = int((y[np.minimum(at, len(y) - 1)] == x).sum()) if len(y) else 0
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([piece["a"].filter(pa.array(ok, pa.bool_())), piece["b"].filter(pa.array(ok, pa.bool_()))], names=["a", "b"])

    with_a = pairs.join(full.select(F.col("id").alias("a"), F.col("shingle_set").alias("set_a")), "a")
    with_both = with_a.join(full.select(F.col("id").alias("b"), F.col("shingle_set").alias("set_b")), "b")
    return with_both.select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """links (a, b) -> id, component: the smallest id reachable. Ids without a link are not listed."""
    both = links.select("a", "b").union(links.select("b", "a")).distinct()
    edges = stored(both, "edges")
    labels = stored(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.min("a"), F.min("b")).alias("component")), "labels")
    while True:
        near = edges.join(labels.select(F.col("id").alias("b"), F.col("component").alias("there")), "b").groupBy(F.col("a").alias("id")).agg(F.min("there").alias("there"))
        lower = labels.join(near, "id").select("id", F.col("component").alias("was"), F.least("component", "there").alias("via"))
        # Pointer jumping: the label of one's label.
        jump = labels.select(F.col("id").alias("via"), F.col("component").alias("further"))
        after = stored(lower.join(jump, "via", "left").select("id", "was", F.least("via", F.coalesce("further", "via")).alias("component")), "labels")
        labels = after.select("id", "component")
        if after.where("component <> was").isEmpty():
            return labels


def prefixes(postings: DataFrame, needed: int) -> DataFrame:
    """postings (id, token) -> id, weight, prefix: see step 2 above. weight: how common its tokens are."""
    lengths = postings.groupBy("token").agg(F.count("*").alias("length")).where("length > 1")
    shared = postings.join(lengths, "token")
    grouped = shared.groupBy("id").agg(F.sum("length").alias("weight"), F.sort_array(F.collect_list(F.struct("length", "token"))).alias("all"))
    return grouped.where(F.size("all") >= needed).select("id", "weight", F.slice("all", F.lit(1), F.size("all") - (needed - 1)).getField("token").alias("prefix"))


def agreeing(pairs: DataFrame, sigs: DataFrame, needed: int) -> DataFrame:
    """Those of the pairs (a, b) whose signatures agree in at least `needed` coordinates."""
    both = pairs.join(sigs.select(F.col("id").alias("a"), F.col("tokens").alias("ta")), "a").join(sigs.select(F.col("id").alias("b"), F.col("tokens").alias("tb")), "b")
    return both.where(F.size(F.filter(F.zip_with("ta", "tb", lambda x, y: x == y), lambda same: same)) >= needed).select("a", "b")


def collisions(one: np.ndarray, others: np.ndarray, needed: int) -> np.ndarray:
    """Rows of `others` (signatures, a coordinate a column) that agree with `one` in at least `needed` coordinates.

    A signature that agrees nowhere in the first coordinates, all but needed - 1 of them, can't reach the count: the
    rest of its coordinates is skipped.
    """
    first = others.shape[1] - needed + 1
    met = np.flatnonzero((others[:, :first] == one[:first]).any(1))
    return met[(others[met] == one).sum(1) >= needed]


def _cell(ids: np.ndarray, component: np.ndarray, outside: np.ndarray, tokens: np.ndarray, packed: list[bytes], needed: int, percent: int) -> list[tuple[int, int]]:
    """Links between the sets marked `outside` and the others that join components: of each two components one at most.

    Pairs come from collisions of signatures and are confirmed on the full sets.
    """
    left, right = np.flatnonzero(outside), np.flatnonzero(~outside)
    if not len(left) or not len(right):
        return []
    others = np.ascontiguousarray(tokens[right])
    up, out = {}, []

    def root(c: int) -> int:
        while up.get(c, c) != c:
            c = up[c]
        return c

    for x in left:
        mine = _unpacked(packed[x])
        for y in right[collisions(tokens[x], others, needed)]:
            a, b = root(int(component[x])), root(int(component[y]))
            if a == b:
                continue
            theirs = _unpacked(packed[y])
            both = len(np.intersect1d(mine, theirs, assume_unique=True))
            if 100 * both >= percent * (len(mine) + len(theirs) - both):
                up[max(a, b)] = min(a, b)
                out.append((min(int(ids[x]), int(ids[y])), max(int(ids[x]), int(ids[y]))))
    return out


def family_links(members: DataFrame, sigs: DataFrame, full: DataFrame, needed: int, percent: int) -> DataFrame:
    """members (family, id, component), distinct -> links (a, b) enough to join all components that a family's links join.

    A family's figures are few rows, but its members may be a third of all: they meet by family and salt.
    """
    parts = 4 * int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    weighed = stored(members.join(full.select("id", (F.octet_length("shingle_set") + 8 * COORDINATES).alias("bytes")), "id"), "weighed")
    sizes = weighed.groupBy("family", "component").agg(F.sum("bytes").alias("bytes")).groupBy("family").agg(F.sum("bytes").alias("all"), F.max("bytes").alias("inside"), F.max_by("component", F.struct("bytes", "component")).alias("largest"))
    blocks = {"all_blocks": F.col("all"), "out_blocks": F.col("all") - F.col("inside")}
    cut = sizes.select("family", "largest", (F.col("all") <= SMALL_BYTES).alias("small"), *(F.greatest(F.ceil(b / CELL_BYTES), F.lit(1)).cast("int").alias(n) for n, b in blocks.items()))
    salted = cut.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    placed = weighed.select("family", "id", "component", F.pmod(F.xxhash64("id", F.lit(5)), F.lit(SALTS)).cast("int").alias("salt")).join(salted, ["family", "salt"]).drop("salt")
    at = F.xxhash64("id", F.lit(99))
    everyone = placed.select("family", "id", "component", "small", F.lit(False).alias("outside"), F.pmod(at, "all_blocks").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("out_blocks") - 1)).alias("j"))
    outside = placed.where("component <> largest").select("family", "id", "component", "small", F.lit(True).alias("outside"), F.explode(F.sequence(F.lit(0), F.col("all_blocks") - 1)).alias("i"), F.pmod(at, "out_blocks").cast("int").alias("j"))
    cell = F.when(F.col("small"), F.pmod(F.xxhash64("family"), F.lit(parts))).otherwise(F.xxhash64("family", "i", "j"))
    known = full.join(sigs, "id")
    dealt = everyone.union(outside).withColumn("cell", cell).join(known, "id").select("cell", "family", "i", "j", "id", "component", "outside", "tokens", "shingle_set")

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by([("family", "ascending"), ("i", "ascending"), ("j", "ascending"), ("id", "ascending")])
        key = np.stack([table[c].to_numpy() for c in ("family", "i", "j")])
        ids, component, outer = table["id"].to_numpy(), table["component"].to_numpy(), table["outside"].to_numpy()
        tokens = table["tokens"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1).tolist(), len(ids)]
        found = []
        for b, e in zip(cuts, cuts[1:], strict=False):
            found += _cell(ids[b:e], component[b:e], outer[b:e], tokens[b:e], table["shingle_set"].slice(b, e - b).to_pylist(), needed, percent)
        return pa.table([pa.array([p[0] for p in found], pa.int64()), pa.array([p[1] for p in found], pa.int64())], names=["a", "b"])

    return dealt.groupBy("cell").applyInArrow(compare, "a long, b long").distinct()


def with_components(members: DataFrame, component: DataFrame | None) -> DataFrame:
    if component is None:
        return members.withColumn("component", F.col("id"))
    return members.join(component, "id", "left").withColumn("component", F.coalesce("component", "id"))


def merged(component: DataFrame | None, found: DataFrame) -> DataFrame:
    """Components (id, component) once the links `found` are added."""
    if component is None:
        return components(found)
    ends = found.join(component.select(F.col("id").alias("a"), F.col("component").alias("ca")), "a", "left").join(component.select(F.col("id").alias("b"), F.col("component").alias("cb")), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a <> b")
    over = components(ends)
    fresh = found.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(component, "id", "left_anti").withColumn("component", F.col("id"))
    return stored(component.unionByName(fresh).join(over.select(F.col("id").alias("component"), F.col("component").alias("to")), "component", "left").select("id", F.coalesce("to", "component").alias("component")), "components")


def links(members: DataFrame, sigs: DataFrame, full: DataFrame, needed: int, percent: int) -> DataFrame:
    """members (token, id, weight) -> id, component of all that have a link; the rounds of step 3 above."""
    component, tried = None, None
    for turn in range(HUB_ROUNDS):
        current = with_components(members, component)
        first = F.struct("weight", "id") if turn == 0 else F.struct(F.xxhash64("id", F.lit(turn)), "id")
        lists = current.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.max_by("id", first).alias("hub"), F.max_by("component", first).alias("hub_component")).where("low < high")
        pairs = current.join(lists, "token").where("component <> hub_component").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = stored(pairs, "pairs")
        if pairs.isEmpty():
            continue
        tried = pairs if tried is None else tried.union(pairs)
        found = stored(confirmed(agreeing(pairs, sigs, needed), full, percent), "links")
        if not found.isEmpty():
            component = merged(component, found)
    current = with_components(members, component)
    lists = current.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.max_by("id", F.struct("weight", "id")).alias("family")).where("low < high").select("token", "family")
    rest = stored(current.join(lists, "token").select("family", "id", "component").distinct(), "families")
    if not rest.isEmpty():
        found = stored(family_links(rest, sigs, full, needed, percent), "links")
        if not found.isEmpty():
            component = merged(component, found)
    return component if component is not None else members.sparkSession.createDataFrame([], "id long, component long")


def classes(docs: DataFrame, *, size: int = 3, percent: int = 85, coordinates: int = COORDINATES) -> DataFrame:
    """`docs` (doc_id, text) -> doc_id, n_shingles, component_id, kept: one row for each row of docs.

    size: words of a shingle; percent: Jaccard similarity of linked texts, at least. Null texts and texts without words
    have an empty set and no link. Rows with the same set, repeated rows among them, are in one class; kept is true for
    the row with the smallest doc_id (for all rows that repeat it). A row without doc_id gives no class its name and
    has no component unless others share its set; it is kept if it has none. Other columns are ignored.
    """
    needed = matches_needed(percent / 100, coordinates)
    docs = docs.select("doc_id", "text")
    signed = stored(signatures(docs, size, coordinates), "signatures")
    full_key = signed.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    representatives = full_key.groupBy("key1", "key2").agg(F.min("doc_id").alias("id"))
    # A representative's own row has its tokens; doc_id may repeat, so one row each.
    first = stored(representatives, "representatives")
    tokens_of = full_key.select(F.col("doc_id").alias("id"), "key1", "key2", "tokens").join(first, ["id", "key1", "key2"], "left_semi")
    prefixed = stored(prefixes(tokens_of.select("id", F.explode("tokens").alias("token")), needed), "prefixes")
    ids = prefixed.select("id").distinct()
    sigs = stored(among(tokens_of.select("id", "tokens"), "id", ids, BROADCAST_IDS).dropDuplicates(["id"]), "member-signatures")
    full = stored(sets(among(docs, "doc_id", ids, BROADCAST_IDS), size).dropDuplicates(["id"]), "member-sets")
    members = stored(prefixed.select(F.explode("prefix").alias("token"), "id", "weight"), "members")
    linked = links(members, sigs, full, needed, percent)
    named = first.join(linked, "id", "left").select("key1", "key2", F.coalesce("component", "id").alias("component"))
    joined = signed.select("doc_id", "n_shingles", "key1", "key2").join(named, ["key1", "key2"], "left")
    component_id = F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", "n_shingles", component_id.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def op7_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(read(spark, sf_dir, "documents"))


OP7_SQL = r"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents
), s as (
  select doc_id, case when ws is null or len(ws) = 0 then []
    when len(ws) < 3 then [array_to_string(ws, ' ')]
    else list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2])) end as sh from w
), n as (select doc_id, len(sh)::bigint as n_shingles from s),
t as (select doc_id, unnest(sh) as g from s),
p as (
  select a.doc_id as a, b.doc_id as b, count(*) as both from t a join t b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2
), e as (
  select p.a, p.b from p join n x on x.doc_id = p.a join n y on y.doc_id = p.b where 100 * p.both >= 85 * (x.n_shingles + y.n_shingles - p.both)
), r as (
  select doc_id, doc_id as c from n union select r.doc_id, e.b from r join e on r.c = e.a
), m as (select doc_id, min(c) as c from r group by 1)
select n.doc_id, n.n_shingles, m.c as component_id, n.doc_id = m.c as kept from n join m using (doc_id)
"""
