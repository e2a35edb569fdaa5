"""Entity resolution: domains, fragments, aliases, duplicates and the match ladder."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import text as X

MIN_PREFIX = 8


def domain_families(rows: DataFrame) -> DataFrame:
    """Domains of more than one entity, and whose (AGG14, AGG15). rows: (entity_id, domain)."""
    return rows.filter("domain is not null").groupBy("domain").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("entity_id")), ",").alias("members")).filter("n > 1")


def domain_pairs(rows: DataFrame) -> DataFrame:
    """A proposal from every entity of a family to its fullest spelling (DET1, JN11, AGG16). rows: (entity_id, name, domain).

    The fullest is aggregated, then joined back: a family is never gathered.
    """
    score = F.struct(X.canonical_score(F.col("name")).alias("s"), (-F.col("entity_id")).alias("o"))
    keep = rows.filter("domain is not null").groupBy("domain").agg(F.max_by("entity_id", score).alias("target_id"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return rows.join(keep, "domain").filter("entity_id <> target_id").select("entity_id", "target_id", "domain", F.lit(0.95).alias("confidence"))


def fragment_pairs(rows: DataFrame) -> DataFrame:
    """Names whose words begin or end another's; beginning wins (JN10, DET2). rows: (name).

    The longer name gives its proper beginnings and ends, which are looked up by equality.
    """
    words = rows.select("name", F.split(F.trim("name"), r"\s+").alias("w"))
    longer = words.filter(F.size("w") > 1).select(F.col("name").alias("full_name"), "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    parts = longer.select("full_name", F.explode(F.array(F.struct(F.lit(0).alias("o"), F.slice("w", F.lit(1), F.col("k")).alias("p")), F.struct(F.lit(1).alias("o"), F.slice("w", F.size("w") - F.col("k") + 1, F.col("k")).alias("p")))).alias("x")).select("full_name", "x.o", F.array_join("x.p", " ").alias("key"))
    found = words.select("name", F.array_join("w", " ").alias("key"), F.size("w").alias("n")).join(parts, "key").filter(F.length("full_name") > F.length("name"))
    best = found.groupBy("name", "full_name").agg(F.min("o").alias("o"), F.max("n").alias("n"))
    return best.select("name", "full_name", F.when(F.col("o") == 0, "prefix").otherwise("suffix").alias("rule"), F.when(F.col("n") == 1, 0.75).otherwise(0.6).alias("confidence"))


def resolve_aliases(seen: DataFrame, aliases: DataFrame) -> DataFrame:
    """Names to entities: the exact text, else a normal form of one entity only, else none (JN9, DET7). seen: (row_id, name); aliases: (alias_text, entity_id)."""
    exact = aliases.groupBy(F.col("alias_text").alias("name")).agg(F.min("entity_id").alias("exact_id"))
    only = aliases.groupBy(X.norm_name(F.col("alias_text")).alias("norm")).agg(F.min("entity_id").alias("norm_id"), F.max("entity_id").alias("_m")).filter("norm_id = _m").drop("_m")
    out = seen.withColumn("norm", X.norm_name(F.col("name"))).join(exact, "name", "left").join(only, "norm", "left")
    method = F.when(F.col("exact_id").isNotNull(), "exact").when(F.col("norm_id").isNotNull(), "normalised").otherwise("unresolved")
    return out.select("row_id", "name", F.coalesce("exact_id", "norm_id").alias("entity_id"), method.alias("method"))


def find_duplicates(asked: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """Live entities that a new name or domain may double: by name, alias, domain, the best reason of each (JN12). asked: (ask_id, name, domain).

    Entities that have merged_into count only where it is null. A pair is told where its best reason is met, by the
    smallest of the names or domains that both sides have, so pairs are never grouped. Asks with the same names and domains,
    and entities with the same of all, meet as blocks of ids: a reason is told for two blocks, and pairs are spread at the end.
    """
    if "merged_into" in entities.columns:
        entities = entities.filter("merged_into is null")
    key = lambda c: F.lower(F.trim(F.col(c)))
    q = asked.groupBy("ask_id").agg(_set(key("name")).alias("names"), _set(F.col("domain")).alias("domains"))
    spelled = aliases.groupBy("entity_id").agg(_set(key("alias_text")).alias("spelled"))
    e = entities.groupBy("entity_id").agg(_set(key("canonical_name")).alias("keys"), _set(F.col("domain")).alias("homes"))
    e = e.join(spelled, "entity_id", "left").withColumn("spelled", F.coalesce("spelled", F.array().cast("array<string>")))
    q, e = _blocks(q, "ask_id", "names", "domains"), _blocks(e, "entity_id", "keys", "homes", "spelled")
    unnamed, unspelled = "not arrays_overlap(names, keys)", "not arrays_overlap(names, spelled)"
    found = [
        _met(q, e, mine, its).filter(f"(size({mine}) = 1 or size({its}) = 1 or k = array_min(array_intersect({mine}, {its}))) and {other}").select(F.explode("ask_ids").alias("ask_id"), "entity_ids").select("ask_id", F.explode("entity_ids").alias("entity_id"), F.lit(on).alias("matched_on"))
        for on, mine, its, other in (("name", "names", "keys", "true"), ("alias", "names", "spelled", unnamed), ("domain", "domains", "homes", f"{unnamed} and {unspelled}"))
    ]
    return found[0].unionByName(found[1]).unionByName(found[2])


#: Ids of a block; entities with one name or domain beyond which they are dealt to several tasks.
BLOCK, HOT = 1024, 4096


def _set(c: Column) -> Column:
    return F.array_sort(F.collect_set(c))


def _parts(rows: DataFrame, keys: list[str], of: Column, most: int) -> DataFrame:
    """(*keys, parts) of keys whose rows have more than `most` of `of`: how many parts hold so much each. A row for `most` at most."""
    return F.broadcast(rows.groupBy(*keys).agg(F.ceil(F.sum(of) / most).alias("parts")).filter("parts > 1"))


def _blocks(rows: DataFrame, by: str, *sets: str) -> DataFrame:
    """(*sets, {by}s): rows with the same sets as blocks of about BLOCK ids, in order."""
    dealt = rows.join(_parts(rows, list(sets), F.lit(1), BLOCK), list(sets), "left").withColumn("part", F.expr(f"pmod(xxhash64({by}), coalesce(parts, 1))"))
    ids = F.array_sort(F.collect_list(F.struct(by)))  # a null is an id too
    return dealt.groupBy(*sets, "part").agg(ids[by].alias(f"{by}s")).drop("part")


def _met(asks: DataFrame, entities: DataFrame, mine: str, its: str) -> DataFrame:
    """Pairs of blocks of asks and of entities that have an element k of these sets in common, a row for each; an element of very many entities is met in several parts.

    Dealt to a fixed number of tasks: what is read is small beside the pairs, so its size doesn't tell the work.
    """
    one, two = asks.withColumn("k", F.explode(mine)), entities.withColumn("k", F.explode(its))
    hot = _parts(two, ["k"], F.size("entity_ids"), HOT)
    one = one.join(hot, "k", "left").withColumn("part", F.explode(F.expr("sequence(0L, coalesce(parts, 1) - 1)"))).drop("parts")
    two = two.join(hot, "k", "left").withColumn("part", F.expr("pmod(xxhash64(entity_ids[0]), coalesce(parts, 1))")).drop("parts")
    tasks = int(asks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a block of entities meets one ask after another, so that its ids come again and again and files stay small
    return two.repartition(tasks, "k", "part").join(one.repartition(tasks, "k", "part"), ["k", "part"])


_TIERS = {1: "exact", 2: "alias", 3: "suffix", 4: "prefix"}


_BEGIN = "left({}, %d)" % MIN_PREFIX


def _keyed(rows: DataFrame, *columns: str) -> DataFrame:
    """A row for each name with its key, to be dealt by the key's first characters; where its stem begins otherwise, one by the key's (by 1) and one by the stem's (by 2)."""
    keyed = rows.withColumn("key", F.coalesce(X.match_key(F.col("name")), F.lit(""))).withColumn("stem", X.stem(F.col("key")))
    near = f"{_BEGIN.format('stem')} = {_BEGIN.format('key')}"
    return keyed.select("key", *columns, F.expr(f"explode(if({near}, array(0), array(1, 2)))").alias("by"))


def _walked(sides: DataFrame) -> DataFrame:
    """(qid, t, pos, rid, name): what each name of a query meets, by tier, its least tiers only; 9 for a name that meets nothing at its key.

    sides: (asks, key, by, qid, pos, rid, name, canonical, seq), asks false for targets, name where it isn't the key.
    Equal keys, equal stems and keys that begin one another share their first MIN_PREFIX characters and stand one after
    another in order, so one walk finds all of them and holds the chain of a key's beginnings. Rows are dealt once; a
    name's second row, at its stem, is made after that. A name of no key is dealt by its query.

    In the walk, kind is 0 and 1 for targets at their key and at their stem, 2 and 3 for queries. An exact key hides the other
    tiers of its query, and a stem at its own key the beginnings. Where no key is equal, one of two equal stems is not its
    name's key, so names whose stem is their key have one row.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain: list[tuple[str, list, list]] = []  # (key, its target, its queries that met nothing else), each a beginning of the next
        place, best, stems, met = None, [], [], []
        for batch in batches:
            for at, kind, key, qid, pos, rid, name, canonical in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != place:
                    place, best, stems = at, [], []
                    while chain and not at.startswith(chain[-1][0]):
                        met += [(qid_, 9, pos_, None, None) for qid_, pos_, found in chain.pop()[2] if not found]
                if kind == 0:  # the first of a key is its record
                    if not best:
                        best.append((rid, at if name is None else name, canonical))
                        if len(at) >= MIN_PREFIX:
                            for w in (w for _, _, waiting in chain for w in waiting):
                                w[2] = True
                                met.append((w[0], 4, w[1], *best[0][:2]))
                            chain.append((at, best, []))
                elif kind == 1:
                    if not stems or stems[-1][0] != key:
                        stems.append((key, rid, key if name is None else name))
                elif kind == 3:
                    met += [(qid, 3, pos, *b[:2]) for b in best] + [(qid, 3, pos, *x[1:]) for x in stems]
                elif best:
                    met.append((qid, 1 if best[0][2] else 2, pos, best[0][0], None))
                elif stems:
                    met += [(qid, 3, pos, *x[1:]) for x in stems]
                elif len(at) < MIN_PREFIX:
                    met.append((qid, 9, pos if at else None, None, None))
                else:
                    begun = [b[0] for _, b, _ in chain if b]
                    met += [(qid, 4, pos, *b[:2]) for b in begun]
                    if not chain or chain[-1][0] != at:
                        chain.append((at, [], []))
                    chain[-1][2].append([qid, pos, bool(begun)])
                if len(met) >= 10_000:
                    yield told(met)
                    met = []
        met += [(qid, 9, pos, None, None) for _, _, waiting in chain for qid, pos, found in waiting if not found]
        yield told(met)

    out = sides.select("qid", F.lit(0).alias("t"), "pos", "rid", "name").schema
    schema = to_arrow_schema(out)
    told = lambda met: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*met, strict=True) if met else [()] * len(schema), schema, strict=True)], schema=schema)
    home = F.when(F.col("by") == 2, X.stem(F.col("key"))).otherwise(F.col("key"))
    dealt = sides.repartition(F.when(F.col("key") == "", F.col("qid").cast("string")).otherwise(F.left(home, F.lit(MIN_PREFIX))))
    places = "explode(filter(array(if(by < 2, named_struct('kind', int(asks) * 2, 'at', key), null), if(by = 2 or by = 0 and stem <> key, named_struct('kind', int(asks) * 2 + 1, 'at', stem), null)), x -> x is not null))"
    rows = dealt.withColumn("stem", X.stem(F.col("key"))).withColumn("x", F.expr(places)).select("*", "x.kind", "x.at")
    order = ["at", "kind", "key", ~F.col("canonical"), "seq", "rid", F.coalesce("name", "key")]
    return rows.sortWithinPartitions(*order).select("at", "kind", "key", "qid", "pos", "rid", "name", "canonical").mapInArrow(walk, out)


def match_ladder(query: DataFrame, target: DataFrame) -> DataFrame:
    """(qid, tier, rid, candidates): exact, alias, suffix, prefix, ambiguous or none (JN15, T11, T12). query: (qid, pos, name); target: (rid, name, canonical, seq).

    Of a key's targets the record is a canonical name before aliases, then the first written (FLW6). Names are dealt once, and
    what they meet is dealt once by query. A query keeps its least tier; ambiguity counts names, as a key has one.
    """
    asks = _keyed(query, "qid", "pos").withColumn("asks", F.lit(True))
    held = _keyed(target, "rid", "name", "canonical", "seq").filter("key <> ''").withColumn("asks", F.lit(False))
    held = held.withColumn("name", F.expr("nullif(name, key)"))  # most often a name is its key
    found = _walked(held.unionByName(asks, allowMissingColumns=True))
    # the least tier is taken first, by a window that spills, and names are gathered only where they are told;
    # window and grouping are served by one shuffle on qid
    own = Window.partitionBy("qid")
    found = found.withColumn("t", F.when((F.col("t") == 1) & (F.col("pos") != F.min("pos").over(own)), 2).otherwise(F.col("t")))
    least = found.withColumn("least", F.min("t").over(own)).filter("t = least")
    best = least.groupBy("qid", "t").agg(F.min("name").alias("a"), F.max("name").alias("z"), F.min_by("rid", "pos").alias("near"), F.array_sort(F.collect_set("name")).alias("names"))
    one = (F.col("t") < 3) | F.coalesce(F.col("a") == F.col("z"), F.lit(False))
    named = F.create_map(*(F.lit(x) for kv in _TIERS.items() for x in kv))
    verdict = F.when(F.col("t") == 9, "none").when(one, named[F.col("t")]).otherwise("ambiguous")
    return best.select("qid", verdict.alias("tier"), F.when(one, F.col("near")).alias("rid"), F.when((F.col("t") < 9) & ~one, F.array_join("names", "|")).alias("candidates"))


def reach(folders: DataFrame, companies: DataFrame, records: DataFrame) -> dict[str, DataFrame]:
    """Folders against both sides, and back (FLW4, JN15-JN17, AGG27).

    folders: (qid, name); companies and records: (rid, name, canonical, seq). Gives the verdicts of both
    sides with segments (rows), tiers of each side, segments, counts, and the companies' own verdicts:
    the same ladder with sides swapped, a company's canonical name first (back).
    """
    names = folders.select("qid", F.lit(0).alias("pos"), "name")
    slides, crm = match_ladder(names, companies), match_ladder(names, records)
    rows = segments(folders.select("qid"), slides.select("qid", "tier"), crm.select("qid", "tier"))
    own = companies.select(F.col("rid").alias("qid"), F.row_number().over(Window.partitionBy("rid").orderBy(F.desc("canonical"), "seq")).alias("pos"), "name")
    back = match_ladder(own, folders.selectExpr("qid rid", "name", "true canonical", "qid seq"))
    tiers = lambda df: df.groupBy("tier").agg(F.count("*").alias("n"))
    hit = lambda c: F.col(c).isin(*_TIERS.values())
    counts = rows.agg(F.count_if(hit("a")).alias("slides"), F.count_if(hit("b")).alias("crm"), F.count_if(hit("a") | hit("b")).alias("either"), F.count_if(~(hit("a") | hit("b"))).alias("neither"))
    return {"rows": rows, "slide_tiers": tiers(slides), "crm_tiers": tiers(crm), "segments": rows.groupBy("segment").agg(F.count("*").alias("n")), "counts": counts, "back": back, "back_tiers": tiers(back)}


def segments(ids: DataFrame, one: DataFrame, other: DataFrame) -> DataFrame:
    """Two independent verdicts as a segment (JN16). one, other: (qid, tier)."""
    hit = lambda c: F.col(c).isin("exact", "alias", "suffix", "prefix")
    rows = ids.join(one.selectExpr("qid", "tier a"), "qid", "left").join(other.selectExpr("qid", "tier b"), "qid", "left")
    return rows.select("qid", "a", "b", F.when(hit("a") & hit("b"), "both").when(hit("b"), "affinity").when(hit("a"), "slides").otherwise("neither").alias("segment"))
