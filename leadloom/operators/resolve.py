"""Finding and merging duplicates.

Grouping always combines on the map side, so a group that holds a large share
of all rows arrives at its reducer as a handful of partial results.  Equality
rules give star links (every member to the smallest id of its group), name
rules give verified pairs from equality joins on pieces of the names, and
connected components join the links to clusters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from leadloom.functions import fixed
from leadloom.functions.contacts import digits
from leadloom.functions.text import bind, norm_key, url_host, url_path
from leadloom.session import cut_lineage, unsent

HOT_PAIRS = 1_000_000  # candidate pairs of one name piece before a longer piece is asked for


# --- keep-first ------------------------------------------------------------

def ordered_distinct(df: DataFrame, value: str, ord: str = "ord", by: list[str] | None = None) -> DataFrame:
    """Case-insensitive distinct values, the first spelling kept."""
    by = by or []
    first = df.filter(F.coalesce(F.col(value), F.lit("")) != "").groupBy(*by, F.lower(value).alias("_key")).agg(
        F.min(F.struct(F.col(ord), F.col(value))).alias("_first")
    )
    return first.select(*by, f"_first.{ord}", f"_first.{value}")


def keep_first(df: DataFrame, keys: list[Column], ord: str = "ord") -> DataFrame:
    """The first row of every key; ``min`` of a struct instead of a window, so hot keys shrink before the shuffle."""
    rest = [c for c in df.columns if c != ord]
    grouped = df.groupBy(*[k.alias(f"_k{i}") for i, k in enumerate(keys)]).agg(
        F.min_by(F.struct(*df.columns), F.col(ord)).alias("_first")
    )
    return grouped.select(*[F.col(f"_first.`{c}`").alias(c) for c in [ord, *rest]]).select(*df.columns)


def seed_domain(url: Column, prefix_only: bool = False) -> Column:
    host = url_host(url)
    if prefix_only:
        return F.regexp_replace(host, r"^(?:www\.)?(?:m\.)?", "")
    return F.replace(F.replace(host, F.lit("www."), F.lit("")), F.lit("m."), F.lit(""))


def dedupe_seeds(seeds: DataFrame, by: list[str] | None = None, max_results: int | None = None,
                 prefix_only: bool = False) -> DataFrame:
    """Distinct seeds: marketplace pages by path, other sites by host; first one kept."""
    by = by or []
    domain = seed_domain(F.col("url"), prefix_only)
    market = domain.isin(fixed.MARKETPLACE_HOSTS)
    key = F.when(market, F.concat(F.lit("/"), url_path(F.col("url")))).otherwise(domain)
    usable = seeds.filter(market | (domain != ""))
    unique = keep_first(usable, [*map(F.col, by), market, key])
    if max_results is None:
        return unique
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("ord")) if by else None
    if rank is None:
        return unique.orderBy("ord").limit(max_results)
    return unique.withColumn("_n", rank).filter(F.col("_n") <= max_results).drop("_n")


def dedupe_listing(seeds: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Distinct listing links by host and path without the trailing slash, within ``by``."""
    url = F.col("url")
    return keep_first(seeds, [*map(F.col, by or []), F.concat(url_host(url), F.regexp_replace(url_path(url), "/+$", ""))])


def discovery_cascade(seeds: DataFrame, max_results: int = 100) -> DataFrame:
    """Which sources of a job are consulted, city by city.

    ``seeds`` has job, city_pos, source (directory1, directory2, web) and ord.
    The second directory is asked while fewer than ten seeds are there, the
    web for the first cities while the total is below ``max_results``.
    Returns the admitted seeds with the mode of their job.
    """
    counts = seeds.groupBy("job", "city_pos").agg(
        F.count_if(F.col("source") == "directory1").alias("d1"),
        F.count_if(F.col("source") == "directory2").alias("d2"),
        F.count_if(F.col("source") == "web").alias("web"),
    )
    earlier = Window.partitionBy("job").orderBy("city_pos").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("job")
    with_second = counts.withColumn(
        "second", F.coalesce(F.sum(F.col("d1") + F.col("d2")).over(earlier), F.lit(0)) + F.col("d1") < fixed.DISCOVERY_ENOUGH
    )
    directory = F.sum(F.col("d1") + F.when(F.col("second"), F.col("d2")).otherwise(0)).over(whole)
    rank = F.row_number().over(Window.partitionBy("job").orderBy("city_pos"))
    plan = with_second.select(
        "job", "city_pos", "second", (directory < max_results).alias("ask_web"),
        ((directory < max_results) & (rank <= fixed.DISCOVERY_CITIES)).alias("web_city"),
        (directory + F.sum(F.when(rank <= fixed.DISCOVERY_CITIES, F.col("web")).otherwise(0)).over(whole)).alias("total"),
    ).withColumn("mode", F.when(F.col("ask_web") & (F.col("total") > 0), "hybrid").otherwise("directory"))
    admitted = (
        (F.col("source") == "directory1")
        | ((F.col("source") == "directory2") & F.col("second"))
        | ((F.col("source") == "web") & F.col("web_city"))
    )
    # written first: a join of plain shuffles can be split where a job is large
    return seeds.join(unsent(cut_lineage(plan)), ["job", "city_pos"]).filter(admitted).select(*seeds.columns, "mode")


# --- merging ---------------------------------------------------------------

def info_parts(df: DataFrame, keys: list[str]) -> DataFrame:
    """All non-empty info texts, one row each; (keys, ord) is their place in the merged text."""
    return df.filter(F.coalesce(F.col("additional_info"), F.lit("")) != "").select(*keys, "ord", "additional_info")


def _fold(parts: Column) -> Column:
    """Info texts put side by side, each left out when it equals all that is there already.

    Only the texts equal to the first one at the very start can be left out,
    unless a later text begins with the first one and the separator.  Then the
    texts are gone through with the place up to which they were put together
    before: a text is compared with what is there only if it is exactly as
    long, and what is there is never copied from text to text, so the work
    grows with the characters of the texts.
    """
    def joined(p: Column) -> Column:
        first = F.get(p, 0)
        new = F.array_position(F.transform(p, lambda x: x != first), True)
        rest = F.when(new > 0, F.slice(p, new.cast("int"), F.size(p))).otherwise(F.slice(p, 1, 0))

        def state(at: Column, chars: Column, text: Column, since: Column) -> Column:
            return F.struct(at.cast("int").alias("at"), chars.cast("long").alias("chars"), text.alias("text"), since.cast("int").alias("since"))

        def put(have: Column) -> Column:
            """``text`` and the texts from place ``since`` to before ``at``, all of which are kept."""
            kept = F.slice(p, have["since"], have["at"] - have["since"])
            between = F.when((have["text"] != "") & (have["at"] > have["since"]), " | ").otherwise("")
            return F.concat(have["text"], between, F.array_join(kept, " | "))

        def step(have: Column, part: Column) -> Column:
            at, chars = have["at"] + 1, have["chars"]
            same = F.when(chars == F.length(part), put(have) == part).otherwise(False)
            longer = chars + F.length(part) + F.when(chars > 0, 3).otherwise(0)
            return F.when(same, state(at, chars, part, at)).otherwise(state(at, longer, have["text"], have["since"]))

        start = state(F.lit(1), F.lit(0), F.lit(""), F.lit(1))
        again = F.exists(p, lambda x: F.startswith(x, F.concat(first, F.lit(" | "))))
        return F.coalesce(F.when(again, F.aggregate(p, start, step, put)), F.array_join(F.concat(F.array(first), rest), " | "))

    return bind(parts, joined)


def merge_cluster(df: DataFrame, keys: list[str]) -> DataFrame:
    """One record per key, merged in ``ord`` order; among rows with the same ``ord`` the smaller value comes first.

    Merge fields take their first non-empty value, other fields stay with the
    first record.  Info texts are put side by side, leaving out a text equal
    to all that is there already.  Most clusters need no look at the single
    texts (none, one, or all equal); for the others all texts are gathered,
    whatever their length: the merged text is one cell of the result.
    """
    c = F.col
    plain = [f for f in df.columns if f not in keys and f not in ("ord", "additional_info")]
    merged_fields = [f for f in plain if f in fixed.MERGE_FIELDS]
    first_fields = [f for f in plain if f not in fixed.MERGE_FIELDS]
    info = F.nullif(c("additional_info"), F.lit(""))
    merged = df.groupBy(*keys).agg(
        F.min("ord").alias("_ord"),
        F.count("*").alias("n_records"),
        F.min(F.struct("ord", *first_fields)).alias("_head"),
        *[F.min(F.when(c(f) != "", F.struct("ord", f)))[f].alias(f) for f in merged_fields],
        F.min(info).alias("_lo"), F.max(info).alias("_hi"),
    )
    several = merged.filter(c("_lo") != c("_hi")).select(*[c(k).alias(f"_k_{k}") for k in keys])
    on = [c(k).eqNullSafe(c(f"_k_{k}")) for k in keys]
    texts = info_parts(df, keys).join(several, on, "left_semi")
    gathered = texts.groupBy(*[c(k).alias(f"_k_{k}") for k in keys]).agg(
        F.sort_array(F.collect_list(F.struct("ord", "additional_info"))).alias("_parts")
    )
    texts_of = gathered.select(*[f"_k_{k}" for k in keys], _fold(F.transform(
        "_parts", lambda p: p["additional_info"])).alias("_folded"))
    out = merged.join(texts_of, on, "left")
    columns = {f: F.coalesce(c(f), F.lit("")) for f in merged_fields}
    columns |= {f: c(f"_head.{f}") for f in first_fields}
    columns["additional_info"] = F.coalesce(c("_folded"), c("_lo"), F.lit(""))
    order = [x for x in df.columns if x not in keys and x != "ord"]
    return out.select(*keys, c("_ord").alias("ord"), "n_records", *[columns[f].alias(f) for f in order])


def exact_keys() -> dict[str, Column]:
    return {"name_key": norm_key(F.col("company_name")), "site_key": norm_key(F.col("website")),
            "mail_key": norm_key(F.col("email"))}


def dedupe_exact(df: DataFrame) -> DataFrame:
    """Merge records with equal name, website and e-mail keys; records without any of them form one group."""
    keyed = df.withColumns(exact_keys())
    return merge_cluster(keyed, list(exact_keys())).drop(*exact_keys())


# --- links -----------------------------------------------------------------

def star_links(df: DataFrame, key: Column, id: str, reason: str) -> DataFrame:
    """Every member of a key group linked to the smallest id of the group: n - 1 links, never all pairs.

    The smallest ids are combined on the map side and written out before they
    are joined back: a join of two plain shuffles is one that adaptive
    execution can split where a group is large; a join on top of the
    aggregate itself is not.
    """
    members = df.select(F.col(id).alias("id"), key.alias("key")).filter(F.coalesce(F.col("key"), F.lit("")) != "")
    centres = members.groupBy("key").agg(F.min("id").alias("centre"), F.max("id").alias("_last"))
    centres = cut_lineage(centres.filter(F.col("centre") != F.col("_last")).drop("_last"))
    return members.join(unsent(centres), "key").filter(F.col("id") != F.col("centre")).select(
        F.col("centre").alias("left_id"), F.col("id").alias("right_id"), F.lit(reason).alias("reason")
    )


def name_nodes(keys: DataFrame) -> DataFrame:
    """Distinct comparison names with the smallest id that carries each; ``keys`` has id and name."""
    return keys.filter(F.col("name") != "").groupBy("name").agg(F.min("id").alias("id"))


def _grams(nodes: DataFrame, sizes: list[int]) -> DataFrame:
    """id, name and each different piece of the name of the given sizes: at most one row per place and size."""
    def cut(n: int) -> Column:
        places = F.sequence(F.lit(1), F.length("name") - n + 1)
        return F.when(F.length("name") >= n, F.transform(places, lambda at: F.substring(F.col("name"), at, F.lit(n))))

    none = F.array().cast("array<string>")
    every = F.array_distinct(F.concat(*[F.coalesce(cut(n), none) for n in sizes]))
    return nodes.select("id", "name", F.explode(every).alias("piece"))


def contained_names(nodes: DataFrame) -> DataFrame:
    """Pairs where one name is part of another.

    A name of four letters or more asks with the rarest of its pieces of four
    letters; every longer name that holds it holds that piece, and pairs are
    verified.  Shorter names are joined with the pieces of their own length.
    Rows grow with the places of a name, whatever its length.
    """
    written = cut_lineage(_grams(nodes, [4]))
    sizes = cut_lineage(written.groupBy("piece").agg(F.count("*").alias("n")))
    rarest = cut_lineage(written.join(sizes, "piece").groupBy("id", "name").agg(
        F.min(F.struct("n", "piece")).alias("least")).select("id", "name", "least.piece"))
    short = nodes.filter(F.length("name") < 4).select("id", "name", F.col("name").alias("piece"))

    def pairs(asking: DataFrame, pieces: DataFrame) -> DataFrame:
        left = asking.select(F.col("id").alias("left_id"), F.col("name").alias("left_name"), "piece")
        right = pieces.select(F.col("id").alias("right_id"), F.col("name").alias("right_name"), "piece")
        both = left.join(right, "piece").filter(F.length("left_name") < F.length("right_name"))
        return both.filter(F.contains("right_name", "left_name")).select("left_id", "right_id", "left_name", "right_name")

    return pairs(rarest, written).unionByName(pairs(short, _grams(nodes, [1, 2, 3])))


def _allowed(length: Column) -> Column:
    """Edits that still leave the wanted similarity for names of this (longer) length."""
    return F.floor(length * (100 - fixed.SIMILAR_PERCENT) / 100).cast("int")


def _pieces(nodes: DataFrame, shorter: bool, kept: int) -> DataFrame:
    """Pieces of names such that similar names share one.

    The shorter name of a pair is cut into k + kept parts, k being the edits
    allowed; at least ``kept`` parts survive unchanged in the longer name, at
    most k places away.  For one part, only the shifts are tried that leave
    it at least one edit for every part before it and every part behind it:
    of the parts that survive, one always lies there.  The key is a hash of the lengths of both names, the
    numbers of the parts and their text; pairs are verified later, so that
    two pieces with the same hash do no harm.
    """
    n = F.length("name")
    if shorter:
        other = F.sequence(n, F.floor(n * 100 / fixed.SIMILAR_PERCENT).cast("int"))
        base = nodes.select("id", "name", n.alias("la"), F.explode(other).alias("lb"))
    else:
        other = F.sequence(F.ceil(n * fixed.SIMILAR_PERCENT / 100).cast("int"), n)
        base = nodes.select("id", "name", F.explode(other).alias("la"), n.alias("lb"))
    base = base.withColumn("k", _allowed(F.col("lb")))
    base = base.filter((F.col("k") > 0) & (F.col("lb") - F.col("la") <= F.col("k")) & (F.col("la") >= F.col("k") + kept))
    parts = F.col("k") + kept

    def start(i: Column) -> Column:
        size, extra = F.floor(F.col("la") / parts), F.pmod(F.col("la"), parts)
        return (i * size + F.greatest(F.lit(0), i - (parts - extra))).cast("int")

    numbered = base
    names_of = ["i", "j"][:kept]
    for position, i in enumerate(names_of):
        low = F.lit(0) if position == 0 else F.col(names_of[position - 1]) + 1
        numbered = numbered.filter(low <= parts - kept + position).withColumn(
            i, F.explode(F.sequence(low, parts - kept + position)))
        if not shorter:
            gap, k = F.col("lb") - F.col("la"), F.col("k")
            if kept == 1:  # some part survives with no more edits before it than parts, and none more behind it either
                behind = k - F.col(i)
                lowest, highest = F.greatest(-F.col(i), gap - behind), F.least(F.col(i), gap + behind)
            else:
                lowest, highest = -F.floor((k - gap) / 2).cast("int"), F.floor((k + gap) / 2).cast("int")
            numbered = numbered.withColumn(f"s{i}", F.explode(F.sequence(lowest, highest)))
            at, length = start(F.col(i)) + F.col(f"s{i}"), start(F.col(i) + 1) - start(F.col(i))
            numbered = numbered.filter((at >= 0) & (at + length <= F.col("lb")))
    texts = []
    for i in names_of:
        shift = F.lit(0) if shorter else F.col(f"s{i}")
        texts.append(F.substring(F.col("name"), start(F.col(i)) + shift + 1, start(F.col(i) + 1) - start(F.col(i))))
    return numbered.select("id", "name", F.xxhash64("la", "lb", *names_of, *texts).alias("key"))


def similar_names(nodes: DataFrame, other_prefix_only: bool = True, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """Pairs of different names within the allowed edit distance.

    With ``other_prefix_only`` only names with different first four
    characters are paired (equal beginnings are linked by the prefix rule),
    and pieces all of whose names begin alike are dropped before any pairing.
    Pieces with more than ``hot_pairs`` candidate pairs are not paired; their
    names are compared on two pieces at a time instead, which again misses
    no pair.
    """
    def paired(a: DataFrame, b: DataFrame) -> DataFrame:
        left = a.select(F.col("id").alias("left_id"), F.col("name").alias("left_name"), "key")
        right = b.select(F.col("id").alias("right_id"), F.col("name").alias("right_name"), "key")
        both = left.join(right, "key")
        lower, upper = F.col("left_name"), F.col("right_name")
        keep = (F.length(lower) < F.length(upper)) | (lower < upper)
        if other_prefix_only:
            keep = keep & (F.substring(lower, 1, 4) != F.substring(upper, 1, 4))
        near = F.levenshtein(lower, upper) * 100 <= F.length(upper) * (100 - fixed.SIMILAR_PERCENT)
        return both.filter(keep).filter(near).select("left_id", "right_id", "left_name", "right_name")

    def groups(a: DataFrame, b: DataFrame) -> DataFrame:
        head = F.substring("name", 1, 4)
        sides = a.select("key", "id", head.alias("head"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(
            b.select("key", "id", head.alias("head"), F.lit(0).alias("a"), F.lit(1).alias("b")))
        sized = sides.groupBy("key").agg(F.sum("a").alias("na"), F.sum("b").alias("nb"),
                                         F.min("head").alias("lo"), F.max("head").alias("hi"),
                                         (F.min("id") != F.max("id")).alias("several"))
        sized = sized.filter((F.col("na") > 0) & (F.col("nb") > 0) & F.col("several"))
        if other_prefix_only:
            sized = sized.filter(F.col("lo") != F.col("hi"))
        return sized.select("key", (F.col("na").cast("double") * F.col("nb") > hot_pairs).alias("hot"))

    a, b = cut_lineage(_pieces(nodes, True, 1)), cut_lineage(_pieces(nodes, False, 1))
    sized = cut_lineage(groups(a, b))
    pairs = paired(a.join(sized.filter(~F.col("hot")).select("key"), "key", "left_semi"), b)
    hot = sized.filter("hot").select("key")
    if hot.isEmpty():
        return pairs.distinct()
    crowded = cut_lineage(a.unionByName(b).join(hot, "key", "left_semi").select("id", "name").distinct())
    a2, b2 = _pieces(crowded, True, 2), _pieces(crowded, False, 2)
    finer = groups(a2, b2).select("key")
    return pairs.unionByName(paired(a2.join(finer, "key", "left_semi"), b2)).distinct()


def similar_pairs(df: DataFrame, id: str = "ord", prefix_rule: bool = True) -> DataFrame:
    """Verified links between records that are duplicates of each other: left_id, right_id, reason, similarity.

    Equality rules (website, e-mail, phone, name, name beginning) link each
    record to the first of its group.  Name parts and similar spellings are
    links between the first records of two different names.
    """
    c = F.col
    phone = digits(F.coalesce(c("phone"), F.lit("")))
    # the keys are read once per rule: a narrow written copy keeps the work before this point from being redone
    keys = cut_lineage(df.select(
        c(id).alias("id"), norm_key(c("website")).alias("website"), norm_key(c("email")).alias("email"),
        phone.alias("phone"), norm_key(c("company_name")).alias("name")))
    nodes = name_nodes(keys)
    long_phone = F.when(F.length("phone") >= 10, c("phone"))
    equal = [star_links(keys, long_phone if rule == "phone" else c(rule), "id", rule)
             for rule in ("website", "email", "phone", "name")]
    if prefix_rule:
        equal.append(star_links(nodes, F.when(F.length("name") >= 4, F.substring("name", 1, 4)), "id", "name beginning"))
    links = equal[0]
    for part in equal[1:]:
        links = links.unionByName(part)
    contained = contained_names(nodes)
    near = similar_names(nodes, other_prefix_only=prefix_rule)
    distance = F.levenshtein("left_name", "right_name")
    size = F.greatest(F.length("left_name"), F.length("right_name"))
    likeness = F.round(F.lit(1.0) - distance / size, 4)
    named = contained.withColumn("reason", F.lit("name part")).unionByName(
        near.withColumn("reason", F.lit("similar name"))
    ).select("left_id", "right_id", "reason", likeness.alias("similarity"))
    return links.withColumn("similarity", F.lit(1.0)).unionByName(named)


# --- clusters --------------------------------------------------------------

def connected_components(links: DataFrame) -> DataFrame:
    """(id, cluster) for every id that has a link; cluster is the smallest id of the component.

    Alternating large-star and small-star rounds until a round changes no
    link.  The least neighbour of each node is written out before it is joined
    back, so that both sides are plain shuffles and a node with very many
    links can be split.  The links are written to the checkpoint folder after
    every round, so a lost executor costs one round at most.
    """
    u, v = F.col("u"), F.col("v")

    def state(links: DataFrame) -> tuple:
        """Number and digest of the links: one pass instead of a join with those before."""
        hashed = F.xxhash64("u", "v")
        return tuple(links.agg(F.count("*"), F.bit_xor(hashed), F.sum(F.pmod(hashed, F.lit((1 << 31) - 1)))).first())

    edges = cut_lineage(links.select(
        F.greatest("left_id", "right_id").alias("u"), F.least("left_id", "right_id").alias("v")
    ).filter(u != v).distinct())
    before = state(edges)
    while True:
        both = edges.unionByName(edges.select(v.alias("u"), u.alias("v")))
        least = cut_lineage(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
        large = cut_lineage(both.filter(v > u).join(unsent(least), "u").select(v.alias("u"), F.col("m").alias("v")).filter(u != v).distinct())
        smallest = cut_lineage(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(unsent(smallest), "u").filter(v != F.col("m")).select(v.alias("u"), F.col("m").alias("v"))
        after = cut_lineage(small.unionByName(smallest.select("u", F.col("m").alias("v"))).distinct())
        now = state(after)
        if now == before:
            break
        edges, before = after, now
    found = after.select(u.alias("id"), v.alias("cluster"))
    return found.unionByName(found.select(F.col("cluster").alias("id"), "cluster").distinct())


def cluster_ids(df: DataFrame, id: str = "ord", prefix_rule: bool = True) -> DataFrame:
    """Add the cluster of each record; records without a duplicate are their own cluster."""
    clusters = connected_components(similar_pairs(df, id, prefix_rule)).withColumnRenamed("id", id)
    return df.join(unsent(clusters), id, "left").withColumn("cluster", F.coalesce("cluster", F.col(id)))


def dedupe_fuzzy(df: DataFrame, prefix_rule: bool = True) -> DataFrame:
    """Merge all records that are linked by any rule, directly or over others.

    Records are told apart by an id given here; two records with the same
    ``ord`` stay two unless a rule links them.
    """
    # the records are read several times over by the linking rules: work on a written copy
    fixed_input = cut_lineage(df.withColumn("_id", F.monotonically_increasing_id()))
    clustered = cluster_ids(fixed_input, "_id", prefix_rule).drop("_id")
    return merge_cluster(clustered, ["cluster"]).drop("cluster")


def dedupe(df: DataFrame, prefix_rule: bool = True) -> DataFrame:
    """Exact merge first, then the fuzzy one over what is left."""
    return dedupe_fuzzy(dedupe_exact(df).drop("n_records"), prefix_rule)
