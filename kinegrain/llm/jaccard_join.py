"""N-gram Jaccard join: exact links between shingle sets, and their components.

1. Every text becomes a set of 64-bit shingle hashes. Equal sets are one class and
   are never compared.
2. Prefix index in one global order. A part of the hash space, the indexed tokens,
   comes first, by exact document frequency, then hash; the rest follows by hash. Two
   sets that link share a token among their first n - ceil(t n) + 1. Tokens of a
   single class cannot bring a candidate, so only their number is kept for each
   class, and lists hold frequent tokens only where a class has no rarer ones.
3. Lists give each class the leaders it meets most often; pairs that also agree by
   MinHash make families of highly similar sets, and so do all classes that meet in a
   long list. This only decides where pairs are compared, not whether: no list that is
   joined with itself has more than LONG entries, however many copies there are.
4. Inside a family, answers are derived from those of a leader: with D(x) the
   difference of x to the leader l, |x & y| = |l| - |l \\ x| - |l \\ y| + |D(x) & D(y)|.
   Families are compared in blocks of bounded numbers of sets and tokens, first each
   block with a few hubs, then pairs of blocks of like set sizes; pairs of blocks that
   lie in the family's main component already are skipped.
5. Across families, list entries are joined by token and size block, and skipped by
   size and by position: entries at places i and j can share at most
   min(n_x - i, n_y - j) tokens.
6. Links make components by alternating star rounds.

Defined cases: null, empty and blank text has the empty set, n_shingles 0, and is its
own component; texts with fewer words than a shingle are one shingle of all words;
rows with a null doc_id have a null component and link with nothing; repeated rows
are in one component; an empty table gives an empty result. Hashes of 64 bits stand
for shingles and for sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checked_broadcast, connected_components, discard, stored

U = np.uint64
_M1, _M2, _M3 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
#: Sets in a block of a family, hubs that every block is compared with, and tokens that a block may hold.
BLOCK, HUBS, TOKENS = 256, 8, 1 << 18
#: Classes that meet in a list of more entries are of one family; so pairs across families come from shorter lists only.
LONG = 32
#: Words whose hashes a worker remembers.
MEMO = 1 << 17

_WORDS: dict[bytes, int] = {}


def _mixed(v: np.ndarray) -> np.ndarray:
    v = (v ^ (v >> U(30))) * _M2
    v = (v ^ (v >> U(27))) * _M3
    return v ^ (v >> U(31))


def words_of(text: str | None) -> list[bytes]:
    """Words with A-Z lower-cased: bytes.lower and bytes.split know ASCII only."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    words = words_of(text)
    if not words:
        return np.zeros(0, U)
    if len(_WORDS) > MEMO:
        _WORDS.clear()
    memo = _WORDS
    try:
        a = np.fromiter(map(memo.__getitem__, words), U, len(words))
    except KeyError:
        for w in words:
            if w not in memo:
                memo[w] = xxhash.xxh64_intdigest(w)
        a = np.fromiter(map(memo.__getitem__, words), U, len(words))
    n = min(size, len(words))
    with np.errstate(over="ignore"):
        h = np.full(len(words) - n + 1, U(n), U)
        for k in range(n):
            h = _mixed(h * _M1 + a[k : len(words) - n + 1 + k])
    return np.unique(h)


def set_key(h: np.ndarray) -> int:
    """The class of a set, as a signed 64-bit hash."""
    return xxhash.xxh64_intdigest(h.tobytes()) - (1 << 63)


def prefix_length(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1


def indexed(num: int, den: int) -> int:
    """One of so many hashes is an indexed token: about twice as many as a prefix has, so that a prefix can choose rare ones."""
    return max(2, -(-den // (2 * max(1, den - num))))


def _index_rows(size: int, num: int, den: int):
    one_of = U(indexed(num, den))

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for lo in range(0, len(pdf), 512):
                few = pdf.iloc[lo : lo + 512]
                ns, keys, tokens, more, sketches = [], [], [], [], []
                for text in few["text"]:
                    h = shingle_set(text, size)
                    n = len(h)
                    first = (h >> U(20)) % one_of == 0
                    own, rest = h[first], h[~first]
                    short = prefix_length(n, num, den) - len(own) if n else 0
                    extra = rest[: max(0, short)]
                    bins = h & U(15)
                    order = np.flatnonzero(np.r_[True, np.diff(np.sort(bins))]) if n else []
                    by_bin = h[np.argsort(bins, kind="stable")] if n else h
                    ns.append(n)
                    keys.append(set_key(h) if n else None)
                    tokens.append(np.concatenate([own, extra]).view(np.int64))
                    more.append(short > 0)
                    sketches.append(by_bin[order].view(np.int64) if n else np.zeros(0, np.int64))
                yield pd.DataFrame(
                    {"doc_id": few["doc_id"].values, "n": ns, "cls": pd.array(keys, "Int64"), "tokens": tokens, "short": more, "sketch": sketches}
                )

    return rows


def _links_in(key: list[int], sets: list[np.ndarray], comps: list[int], num: int, den: int) -> list[tuple[int, int]]:
    """Links that join different components of these sets; as few as join them all."""
    order = sorted(range(len(key)), key=lambda i: key[i])
    order = [i for k, i in enumerate(order) if not k or key[i] != key[order[k - 1]]]
    key, sets, comps = ([x[i] for i in order] for x in (key, sets, comps))
    m = len(key)
    if m < 2:
        return []
    sizes = np.array([len(s) for s in sets], np.int64)
    leader = sets[int(np.argsort(sizes)[m // 2])]
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(m), sizes)
    at = np.minimum(np.searchsorted(leader, flat), len(leader) - 1)
    held = leader[at] == flat
    shared = np.bincount(owner[held], minlength=m)
    missing = len(leader) - shared
    # D(x): leader's tokens that x misses, and x's tokens that the leader misses
    extra_tokens, extra_place = np.unique(flat[~held], return_inverse=True)
    inter = len(leader) - missing[:, None] - missing[None, :]
    inter = inter.astype(np.float64)
    miss = np.ones((m, len(leader)), np.float32)
    miss[owner[held], at[held]] = 0
    inter += miss @ miss.T
    del miss
    often = np.bincount(extra_place, minlength=len(extra_tokens)) > 1
    column = np.cumsum(often) - 1
    o, c = owner[~held], extra_place
    keep = often[c]
    o, c = o[keep], column[c[keep]]
    sort = np.argsort(c, kind="stable")
    o, c = o[sort], c[sort]
    width = int(often.sum())
    for lo in range(0, width, 4096):
        a, b = np.searchsorted(c, [lo, lo + 4096])
        part = np.zeros((m, min(4096, width - lo)), np.float32)
        part[o[a:b], c[a:b] - lo] = 1
        inter += part @ part.T
    inter = np.rint(inter).astype(np.int64)
    # what a set shares with itself counts all its tokens, also those that no other has
    linked = den * inter >= num * (sizes[:, None] + sizes[None, :] - inter)
    names: dict[int, int] = {}
    group = [names.setdefault(x, len(names)) for x in comps]
    parent = list(range(len(names)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i, j in zip(*np.nonzero(np.triu(linked, 1))):
        a, b = root(group[i]), root(group[j])
        if a != b:
            parent[a] = b
            out.append((key[i], key[j]))
    return out


def _compare(num: int, den: int):
    """Streams through rows sorted by group and compares each group's sets."""

    def links(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, key, sets, comps = None, [], [], []
        found: list[tuple[int, int]] = []
        for pdf in parts:
            for g, k, c, t in zip(pdf["grp"], pdf["cls"], pdf["comp"], pdf["tokens"]):
                if g != group:
                    found += _links_in(key, sets, comps, num, den)
                    group, key, sets, comps = g, [], [], []
                key.append(int(k))
                comps.append(int(c))
                sets.append(np.frombuffer(t, U))
            if found:
                yield pd.DataFrame(found, columns=["a", "b"])
                found = []
        found += _links_in(key, sets, comps, num, den)
        if found:
            yield pd.DataFrame(found, columns=["a", "b"])

    return links


def _compared(places: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) found inside the groups of places (grp, cls, comp)."""
    rows = places.join(sets, "cls").select("grp", "cls", "comp", "tokens")
    return stored(
        rows.repartition("grp").sortWithinPartitions("grp").mapInPandas(_compare(num, den), "a long, b long"), "links"
    )


def jaccard_components(docs: DataFrame, *, size: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs (doc_id, text); sets link at num/den Jaccard similarity."""
    return _classed(docs, size, num, den).select("doc_id", "n_shingles", "component_id")


def _classes(docs: DataFrame, size: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, cls) of each row, and the classes: rep, n, k (indexed tokens), short, sketch and tokens of one row of each."""
    kind = dict(docs.dtypes)["doc_id"]
    index = stored(
        docs.select("doc_id", "text").mapInPandas(
            _index_rows(size, num, den),
            f"doc_id {kind}, n long, cls long, tokens array<long>, short boolean, sketch array<long>",
        ),
        "index",
    )
    # copies meet before the shuffle: of a class with a third of all rows each task passes on one
    one = [F.first(c).alias(c) for c in ("n", "short", "sketch", "tokens")]
    usable = index.where("cls is not null and doc_id is not null")
    classes = usable.groupBy("cls").agg(F.min("doc_id").alias("rep"), *one).withColumn("k", F.size("tokens"))
    classes = stored(classes, "classes")
    every = stored(index.select("doc_id", "n", "cls"), "rows")
    discard(index)
    return every, classes


def _postings(classes: DataFrame, num: int, den: int) -> DataFrame:
    """h, cls, n, place: the prefix index over tokens of several classes."""
    entries = classes.select("cls", F.explode("tokens").alias("h"))
    common = stored(entries.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "common")
    shared = entries.join(common.hint("shuffle_hash"), "h")
    own = Window.partitionBy("cls")
    ranked = shared.withColumns({"r": F.row_number().over(own.orderBy("df", "h")), "v": F.count(F.lit(1)).over(own)})
    found = ranked.join(classes.select("cls", "n", "k", "short"), "cls").withColumn("rank", F.col("k") - F.col("v") + F.col("r"))
    length = F.col("n") - F.ceil(F.lit(num) * F.col("n") / F.lit(den)) + 1
    # short classes hold tokens beyond the indexed part: their places are not in the global order, so position can't skip them
    place = F.when(F.col("short"), F.lit(0)).otherwise(F.col("rank") - 1).alias("place")
    postings = stored(found.where(F.col("short") | (F.col("rank") <= length)).select("h", "cls", "n", place), "postings")
    discard(common)
    return postings


def _families(postings: DataFrame, heads: DataFrame, classes: DataFrame) -> DataFrame:
    """cls, fam: classes that meet in one long list, or meet often and agree by MinHash."""
    met = postings.join(heads, "h").where("cls <> head").groupBy("cls", "head")
    met = met.agg(F.count(F.lit(1)).alias("times"), F.max(F.col("m") > LONG).alias("long"))
    rank = F.row_number().over(Window.partitionBy("cls").orderBy(F.desc("times"), "head"))
    top = stored(met.withColumn("r", rank).where("r <= 2 or long").select("cls", "head", "long"), "met")
    sk = classes.select("cls", "sketch")
    alike = (
        top.where("not long")
        .join(sk, "cls")
        .join(sk.select(F.col("cls").alias("head"), F.col("sketch").alias("other")), "head")
        .where(F.size(F.array_intersect("sketch", "other")) >= 0.4 * F.greatest(F.size("sketch"), F.size("other")))
    )
    edges = alike.select("cls", "head").union(top.where("long").select("cls", "head"))
    found = connected_components(edges.select(F.col("cls").alias("a"), F.col("head").alias("b")))
    family = stored(found.select(F.col("node").alias("cls"), F.col("component").alias("fam")), "family")
    discard(top)
    return family


def _pairs_across(postings: DataFrame, heads: DataFrame, family: DataFrame, num: int, den: int) -> DataFrame:
    """cls, cls2: candidates of different families, which only meet in lists of at most LONG entries."""
    step = F.lit(float(np.log(den / num)) if num < den else 1e-9)
    short_lists = heads.where(F.col("m") <= LONG).select("h")
    placed = postings.join(short_lists, "h").join(family, "cls", "left").withColumn("fam", F.coalesce("fam", "cls"))
    placed = placed.withColumn("sb", F.floor(F.log(F.col("n").cast("double")) / step).cast("long"))
    whole_list = Window.partitionBy("h")
    mixed = placed.withColumns({"lo": F.min("fam").over(whole_list), "hi": F.max("fam").over(whole_list)}).where("lo <> hi")
    placed = stored(mixed.drop("lo", "hi"), "placed")
    other = placed.select(
        "h", F.col("cls").alias("cls2"), F.col("n").alias("n2"), F.col("place").alias("place2"), F.col("fam").alias("fam2"),
        F.explode(F.array(F.col("sb") - 1, F.col("sb"), F.col("sb") + 1)).alias("sb"),
    )
    need = F.ceil(F.lit(num) * (F.col("n") + F.col("n2")) / F.lit(num + den))
    bound = F.least(F.col("n") - F.col("place"), F.col("n2") - F.col("place2"))
    pairs = stored(
        placed.join(other, ["h", "sb"])
        .where("cls < cls2 and fam <> fam2")
        .where((F.lit(den) * F.least("n", "n2") >= F.lit(num) * F.greatest("n", "n2")) & (bound >= need))
        .select("cls", "cls2")
        .distinct(),
        "pairs",
    )
    discard(placed)
    return pairs


def _name(*cols) -> Column:
    return F.xxhash64(*cols)


def _blocks(members: DataFrame, by: list[str]) -> DataFrame:
    """by, nb: blocks of at most about BLOCK sets and TOKENS tokens for each group of members."""
    parts = F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)), F.ceil(F.sum("n") / F.lit(TOKENS))).cast("long")
    return stored(members.groupBy(*by).agg(parts.alias("nb"), F.count(F.lit(1)).alias("m")), "blocks")


def _classed(docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """The rows of jaccard_components with cls and root, the classes of a row's set and of its component; nulls for the empty set."""
    every, classes = _classes(docs, size, num, den)
    postings = _postings(classes, num, den)
    heads = stored(postings.groupBy("h").agg(F.min("cls").alias("head"), F.count(F.lit(1)).alias("m")).where("m > 1"), "heads")
    family = _families(postings, heads, classes)
    pairs = _pairs_across(postings, heads, family, num, den)
    discard(postings, heads)

    # whole sets of the classes that are compared, from the texts
    wanted = family.select("cls").union(pairs.select("cls")).union(pairs.select(F.col("cls2").alias("cls"))).distinct()
    wanted = stored(wanted.join(classes.select("cls", "rep"), "cls"), "wanted")

    def whole(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for lo in range(0, len(pdf), 512):
                few = pdf.iloc[lo : lo + 512]
                found = [(c, h.tobytes()) for c, t in zip(few["cls"], few["text"]) if (h := shingle_set(t, size)).size and set_key(h) == c]
                yield pd.DataFrame(found, columns=["cls", "tokens"])

    texts = docs.select(F.col("doc_id").alias("rep"), "text").join(checked_broadcast(wanted), "rep")
    sets = stored(texts.select("cls", "text").mapInPandas(whole, "cls long, tokens binary"), "sets")

    # small families are one block; in large ones a block holds sets of one size step, and some hubs of that step
    step = F.lit(float(np.log(den / num)) if num < den else 1e-9)
    spread = F.xxhash64("cls", F.lit(1))
    members = family.join(classes.select("cls", "n"), "cls")
    members = stored(members.withColumn("sb", F.floor(F.log(F.col("n").cast("double")) / step).cast("long")), "members")
    sizes = _blocks(members, ["fam"])
    big = sizes.where("nb > 1").select("fam")
    small = members.join(checked_broadcast(stored(big, "big")), "fam", "left_anti").select(_name("fam").alias("grp"), "cls", F.col("cls").alias("comp"))
    apart = pairs.withColumn("grp", _name("cls", "cls2", F.lit("pair")))
    apart = apart.select("grp", F.explode(F.array("cls", "cls2")).alias("cls")).withColumn("comp", F.col("cls"))
    groups = small.unionByName(apart)
    large = stored(members.join(checked_broadcast(stored(big, "big")), "fam"), "large")
    spacious = large.take(1) != []
    if spacious:
        cut = _blocks(large, ["fam", "sb"])
        own = large.join(checked_broadcast(cut), ["fam", "sb"]).withColumn("b", F.pmod(spread, "nb"))
        hub = own.where(F.pmod(spread, F.greatest(F.lit(1), F.floor(F.col("m") / F.lit(HUBS)).cast("long"))) == 0).where("nb > 1")
        hub = hub.withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)))
        inner = own.unionByName(hub).select(_name("fam", "sb", "b").alias("grp"), "cls", F.col("cls").alias("comp")).distinct()
        groups = groups.unionByName(inner)
    links = _compared(groups, sets, num, den)

    # large families: pairs of blocks of like sizes, of which those within the main component are skipped
    if spacious:
        comp = stored(connected_components(links).select(F.col("node").alias("cls"), "component"), "comp")
        state = stored(large.join(comp, "cls", "left").select("fam", "sb", "n", "cls", F.coalesce("component", "cls").alias("comp")), "state")
        main = state.groupBy("fam", "comp").agg(F.count(F.lit(1)).alias("c")).groupBy("fam").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"))
        state = stored(state.join(checked_broadcast(stored(main, "main")), "fam").withColumn("z", F.col("comp") != F.col("main")), "state")
        cut = _blocks(state, ["fam", "sb", "z"])
        placed = state.join(checked_broadcast(cut), ["fam", "sb", "z"]).withColumn("b", F.pmod(spread, "nb"))
        near = placed.withColumn("sb2", F.explode(F.array(F.col("sb") - 1, F.col("sb"), F.col("sb") + 1)))
        other = cut.select("fam", F.col("sb").alias("sb2"), F.col("z").alias("z2"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)).alias("b2"))
        met = near.join(checked_broadcast(stored(other, "other")), ["fam", "sb2"]).where("z or z2")
        mine, theirs = F.struct("sb", "z", "b"), F.struct(F.col("sb2").alias("sb"), F.col("z2").alias("z"), F.col("b2").alias("b"))
        put = met.select(_name("fam", F.least(mine, theirs), F.greatest(mine, theirs), F.lit("two")).alias("grp"), "cls", "comp")
        links = links.union(_compared(put, sets, num, den))

    joined = connected_components(links)
    label = joined.select(F.col("node").alias("cls"), F.col("component").alias("root"))
    named = stored(classes.select("cls", "rep").join(label, "cls").select("cls", "rep", "root"), "named")
    least = stored(named.groupBy("root").agg(F.min("rep").alias("component_id")), "least")
    # only classes with links: the others are their own component
    named = stored(named.join(checked_broadcast(least), "root").select("cls", "root", "component_id"), "named")
    single = classes.select("cls", "rep")
    named = stored(
        single.join(checked_broadcast(named), "cls", "left").select("cls", F.coalesce("root", "cls").alias("root"), F.coalesce("component_id", "rep").alias("component_id")),
        "named",
    )
    discard(sets, pairs, family)
    out = every.withColumnRenamed("n", "n_shingles").join(named, "cls", "left")
    own_id = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", "cls", "root", F.when(F.col("doc_id").isNotNull(), own_id).alias("component_id"))


def one_of_each(docs: DataFrame, *, size: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """docs with one row of each component, that of the least doc_id; rows with a null doc_id stay.

    Rows that repeat a doc_id with another text stay if their text's component has that doc_id;
    of equal rows one stays.
    """
    found = stored(_classed(docs, size, num, den), "components")
    own = F.col("doc_id") == F.col("component_id")
    ids = found.groupBy(F.col("doc_id").alias("_id")).agg(F.count(F.lit(1)).alias("_n"), F.bool_or(own).alias("_own"))
    keep = stored(ids.where("_own").select("_id", "_n"), "kept")
    near = docs.select(F.struct(*docs.columns).alias("_row")).join(checked_broadcast(keep), F.col("_row.doc_id") == F.col("_id"))
    once = near.where("_n = 1").select("_row.*")
    # only rows of repeated ids are told apart by class, one for each component; the others stay where they are
    repeated = found.where(own).join(checked_broadcast(keep).where("_n > 1"), F.col("doc_id") == F.col("_id"))
    chosen = repeated.groupBy("_id", "root").agg(F.min("cls").alias("_cls")).select(F.col("_id").alias("_of"), "_cls")

    @F.pandas_udf("long")
    def class_of(texts: pd.Series) -> pd.Series:
        return pd.Series([set_key(h) if (h := shingle_set(t, size)).size else None for t in texts], dtype="Int64")

    many = near.where("_n > 1").withColumn("_key", class_of("_row.text"))
    many = many.join(checked_broadcast(stored(chosen, "chosen")), (F.col("_id") == F.col("_of")) & F.col("_key").eqNullSafe(F.col("_cls")))
    many = many.groupBy("_id", "_key").agg(F.min_by("_row", F.xxhash64("_row.text")).alias("_row"))
    return once.unionByName(many.select("_row.*")).unionByName(docs.where("doc_id is null"))
