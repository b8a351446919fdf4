"""Records to dated quads and typed nodes: field mapping only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from risewatch.functions.text import blank_to_null, fallback_id, tail_id
from risewatch.operators.core import spread
from risewatch.schemas import FRAGMENT_RELATIONS, FRAGMENTS, PAIR_RELATIONS, PAIRS, TECH_TYPES

NODE_COLUMNS = ("id", "type", "entity_id", "name", "source", "pub_date", "doi", "kind", "url", "stars", "tone")


def work_id(c: Column) -> Column:
    """URL ids are cut to their last segment; ``doi:`` ids contain slashes and stay whole."""
    return F.when(c.startswith("doi:"), c).otherwise(tail_id(c))


def _quad(head: Column, head_type: str, relation: str, tail: Column, tail_type: str, time: Column, source: Column):
    return [
        head.alias("head"),
        F.lit(head_type).alias("head_type"),
        F.lit(relation).alias("relation"),
        tail.alias("tail"),
        F.lit(tail_type).alias("tail_type"),
        time.alias("time"),
        source.alias("source"),
    ]


# How the id of a node is made from what its row holds.
_PLAIN, _TAIL, _WORK, _NAMED, _OWN = 0, 1, 2, 3, 4  # the last also brings its own source
_EXTRA = {"pub_date": "string", "doi": "string", "kind": "string", "url": "string", "stars": "bigint", "tone": "double"}
_ITEMS = "array<struct<raw:string,by:int,type:string,name:string,origin:string," + ",".join(f"{c}:{t}" for c, t in _EXTRA.items()) + ">>"


def _item(raw: Column, by: int, type_: str, name: Column, origin: Column | None = None, **extra: Column) -> Column:
    more = [extra.get(c, F.lit(None)).cast(t).alias(c) for c, t in _EXTRA.items()]
    return F.struct(raw.cast("string").alias("raw"), F.lit(by).alias("by"), F.lit(type_).alias("type"), name.cast("string").alias("name"), (F.lit(None) if origin is None else origin).cast("string").alias("origin"), *more)


def _items(array: Column, make) -> Column:
    return F.coalesce(F.transform(array, make).cast(_ITEMS), F.array().cast(_ITEMS))


def _nodes(records: DataFrame, source: Column, *parts: Column) -> DataFrame:
    """Node rows of all ``parts`` (arrays of items) in one scan; ids are made after the arrays are spread."""
    rows = records.select(source.alias("source"), F.inline(F.concat(*[p.cast(_ITEMS) for p in parts])))
    by, raw = F.col("by"), F.col("raw")
    ident = (
        F.when(by == _TAIL, tail_id(raw)).when(by == _WORK, work_id(raw))
        .when(by == _NAMED, fallback_id(F.col("source"), F.col("type"), F.col("name"))).otherwise(raw)
    )
    values = {"id": ident, "entity_id": F.when(by != _NAMED, ident), "source": F.when(by == _OWN, F.col("origin")).otherwise(F.col("source"))}
    return rows.select(*[values.get(c, F.col(c)).alias(c) for c in NODE_COLUMNS])


def best_concepts(concepts: Column, n: int | None = None) -> Column:
    """All elements, or the ``n`` with the highest score (null as 0), ties in list order; sorted inside the row."""
    ranked = F.transform(
        F.filter(concepts, lambda c: c["id"].isNotNull() & (c["id"] != "")),
        lambda c, i: F.struct((-F.coalesce(c["score"], F.lit(0.0))).alias("k"), i.alias("pos"), c.alias("c")),
    )
    ranked = F.array_sort(ranked)
    return F.transform(ranked if n is None else F.slice(ranked, 1, n), lambda r: r["c"])


def _works(works: DataFrame) -> DataFrame:
    return works.select(
        work_id(F.col("id")).alias("head"),
        F.col("publication_date").alias("time"),
        F.coalesce("source", F.lit("openalex")).alias("src"),
        "concepts",
        "authorships",
        "referenced_works",
        "title",
        "doi",
    ).where(F.col("head").isNotNull())


def _first(array: str, n: int | None) -> Column:
    return F.col(array) if n is None else F.slice(array, 1, n)


def extract_work_triples(works: DataFrame, max_concepts: int | None = None, max_refs: int | None = None) -> DataFrame:
    """Concepts, authors, institutions of every author and references; one scan of the works.

    ``max_concepts`` and ``max_refs`` ask for the best concepts and first references only.

    All quads of a work are built as one array in its row and exploded once, so there is no shuffle.
    """
    w = _works(works)

    shape = "array<struct<relation:string,raw:string,tail_type:string>>"

    def quads(items: Column, relation: str, tail_type: str) -> Column:
        rows = F.transform(
            items, lambda t: F.struct(F.lit(relation).alias("relation"), t.alias("raw"), F.lit(tail_type).alias("tail_type"))
        )
        return F.coalesce(rows, F.array().cast(shape))

    places = F.flatten(F.transform("authorships", lambda a: F.coalesce(a["institutions"]["id"], F.array().cast("array<string>"))))
    every = F.concat(
        quads(best_concepts(F.col("concepts"), max_concepts)["id"], "belongs_to", "Concept"),
        quads(F.col("authorships.author.id"), "authored_by", "Author"),
        quads(places, "affiliated_with", "Institution"),
        quads(_first("referenced_works", max_refs), "cites", "Paper"),
    )
    # Ids are cut after the explode, in generated code rather than inside the array functions.
    rows = w.select("head", "time", "src", F.inline(every))
    tail = F.when(F.col("relation") == "cites", work_id(F.col("raw"))).otherwise(tail_id(F.col("raw")))
    return rows.select(
        "head",
        F.lit("Paper").alias("head_type"),
        "relation",
        tail.alias("tail"),
        "tail_type",
        "time",
        F.col("src").alias("source"),
    ).where(F.col("tail") != "")


def work_nodes(works: DataFrame, max_refs: int | None = None) -> DataFrame:
    """Node rows (not yet merged): the work, its concepts, authors, institutions, and bare referenced works."""
    places = F.flatten(F.transform("authorships", lambda a: F.coalesce(a["institutions"], F.array().cast("array<struct<id:string,name:string>>"))))
    nodes = _nodes(
        _works(works), F.col("src"),
        F.array(_item(F.col("head"), _PLAIN, "Paper", F.col("title"), pub_date=F.col("time"), doi=F.col("doi"))),
        _items(F.col("concepts"), lambda c: _item(c["id"], _TAIL, "Concept", c["name"])),
        _items(F.col("authorships"), lambda a: _item(a["author"]["id"], _TAIL, "Author", a["author"]["name"])),
        _items(places, lambda i: _item(i["id"], _TAIL, "Institution", i["name"])),
        _items(_first("referenced_works", max_refs), lambda r: _item(r, _WORK, "Paper", F.lit(None))),
    )
    return nodes.where(F.col("id").isNotNull() & (F.col("id") != ""))


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _with_id(records: DataFrame) -> DataFrame:
    return records.where(F.col("id").isNotNull() & (F.col("id") != ""))


def extract_preprint_triples(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Category concepts and hashed authors, with their nodes."""
    r, src = _with_id(records), F.lit("arxiv")
    cats = r.select("id", "publication_date", F.explode("categories").alias("v"))
    people = r.select("id", "publication_date", F.explode("authors.name").alias("v")).where(
        F.col("v").isNotNull() & (F.col("v") != "")
    )
    cat, person = F.concat(F.lit("cat:"), F.col("v")), fallback_id(src, F.lit("Author"), F.col("v"))
    head, time = F.col("id"), F.col("publication_date")
    triples = cats.select(*_quad(head, "Paper", "belongs_to", cat, "Concept", time, src)).unionByName(
        people.select(*_quad(head, "Paper", "authored_by", person, "Author", time, src))
    )
    named = F.filter(F.col("authors.name"), lambda v: v.isNotNull() & (v != ""))
    nodes = _nodes(
        r, src,
        F.array(_item(head, _PLAIN, "Paper", F.col("title"), pub_date=time, doi=F.col("doi"))),
        _items(F.col("categories"), lambda v: _item(F.concat(F.lit("cat:"), v), _PLAIN, "Concept", v)),
        _items(named, lambda v: _item(v, _NAMED, "Author", v)),
    )
    return triples, nodes


def extract_patent_triples(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classification concepts, hashed assignees (Institution) and inventors (Person), with their nodes."""
    r, src = _with_id(records), F.lit("uspto")
    head, time, v = F.col("id"), F.col("publication_date"), F.col("v")
    pick = lambda c: r.select("id", "publication_date", F.explode(c).alias("v"))
    cpc, firms, people = pick("cpc"), pick("assignees"), pick("inventors")
    code = F.concat(F.lit("cpc:"), v)
    firm, person = fallback_id(src, F.lit("Institution"), v), fallback_id(src, F.lit("Person"), v)
    triples = _union(
        [
            cpc.select(*_quad(head, "Patent", "belongs_to", code, "Concept", time, src)),
            firms.select(*_quad(head, "Patent", "affiliated_with", firm, "Institution", time, src)),
            people.select(*_quad(head, "Patent", "authored_by", person, "Person", time, src)),
        ]
    )
    nodes = _nodes(
        r, src,
        F.array(_item(head, _PLAIN, "Patent", F.col("title"), pub_date=time, kind=F.col("kind"))),
        _items(F.col("cpc"), lambda c: _item(F.concat(F.lit("cpc:"), c), _PLAIN, "Concept", c)),
        _items(F.col("assignees"), lambda c: _item(c, _NAMED, "Institution", c)),
        _items(F.col("inventors"), lambda c: _item(c, _NAMED, "Person", c)),
    )
    return triples, nodes


def extract_repo_triples(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Topic concepts of repositories, with their nodes."""
    r, src = _with_id(records), F.lit("github")
    head, time, v = F.col("id"), F.col("created_at"), F.col("v")
    topics = r.select("id", "created_at", F.explode("topics").alias("v"))
    topic = F.concat(F.lit("topic:"), v)
    triples = topics.select(*_quad(head, "Repo", "belongs_to", topic, "Concept", time, src))
    nodes = _nodes(
        r, src,
        F.array(_item(head, _PLAIN, "Repo", F.col("name"), url=F.col("url"), stars=F.col("stars"), pub_date=time)),
        _items(F.col("topics"), lambda c: _item(F.concat(F.lit("topic:"), c), _PLAIN, "Concept", c)),
    )
    return triples, nodes


def extract_news_triples(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Theme concepts and mentioned persons and organisations, with their nodes."""
    r = _with_id(records).withColumn("src", F.coalesce(blank_to_null(F.col("source")), F.lit("news")))
    head, time, src, v = F.col("id"), F.col("publication_date"), F.col("src"), F.col("v")
    pick = lambda c: r.select("id", "publication_date", "src", F.explode(c).alias("v"))
    themes, persons, firms = pick("themes"), pick("persons"), pick("organizations")
    theme = F.concat(F.lit("theme:"), v)
    person, firm = fallback_id(src, F.lit("Person"), v), fallback_id(src, F.lit("Institution"), v)
    triples = _union(
        [
            themes.select(*_quad(head, "News", "belongs_to", theme, "Concept", time, src)),
            persons.select(*_quad(head, "News", "mentions", person, "Person", time, src)),
            firms.select(*_quad(head, "News", "mentions", firm, "Institution", time, src)),
        ]
    )
    nodes = _nodes(
        r, src,
        F.array(_item(head, _OWN, "News", F.col("title"), F.col("source"), url=F.col("url"), pub_date=time, tone=F.col("tone"))),
        _items(F.col("themes"), lambda c: _item(F.concat(F.lit("theme:"), c), _PLAIN, "Concept", c)),
        _items(F.col("persons"), lambda c: _item(c, _NAMED, "Person", c)),
        _items(F.col("organizations"), lambda c: _item(c, _NAMED, "Institution", c)),
    )
    return triples, nodes


def dedupe_earliest(triples: DataFrame) -> DataFrame:
    """One row per (head, relation, tail): the earliest time, an empty time first; ties by source and types."""
    rest = [c for c in triples.columns if c not in ("head", "relation", "tail")]
    key = F.struct(
        F.coalesce("time", F.lit("")), *[F.coalesce(c, F.lit("")) for c in ("source", "head_type", "tail_type")]
    )
    best = triples.groupBy("head", "relation", "tail").agg(F.min_by(F.struct(*rest), key).alias("_b"))
    return best.select("head", "relation", "tail", "_b.*").select(*triples.columns)


def merge_nodes(nodes: DataFrame, order: Column) -> DataFrame:
    """One row per (type, id); every attribute is its first non-null, non-blank value in ``order``.

    Equal rows are met once: repeats go in a hash aggregate inside the tasks, so that few rows are sorted for the merge.
    """
    attrs = [c for c in nodes.columns if c not in ("type", "id")]
    text = {f.name for f in nodes.schema.fields if f.dataType.simpleString() == "string"}

    def first_value(c: str) -> Column:
        filled = F.col(c).isNotNull() & (F.col(c) != "") if c in text else F.col(c).isNotNull()
        return F.min_by(F.when(filled, F.col(c)), F.when(filled, order)).alias(c)

    keep = F.col("id").isNotNull() & (F.col("id") != "") & F.col("type").isNotNull()
    return nodes.where(keep).distinct().groupBy("type", "id").agg(*[first_value(c) for c in attrs]).select(*nodes.columns)


def relation_counts(triples: DataFrame) -> DataFrame:
    return triples.groupBy("relation").agg(F.count(F.lit(1)).alias("n"))


def union_triples(structured: Sequence[DataFrame], directed: DataFrame) -> DataFrame:
    """Deduplicated quad families plus directed pairs, whose repeats are kept as support."""
    return dedupe_earliest(_union(list(structured))).unionByName(directed)


def dedupe_by_id(df: DataFrame, order: Column, ident: str = "id") -> DataFrame:
    """First row per id in ``order``; rows without an id are dropped."""
    rest = [c for c in df.columns if c != ident]
    kept = df.where(F.col(ident).isNotNull() & (F.col(ident) != ""))
    return kept.groupBy(ident).agg(F.min_by(F.struct(*rest), order).alias("_b")).select(ident, "_b.*").select(*df.columns)


def json_block(c: Column) -> Column:
    """Outermost ``{...}`` of a model answer; code fences and chatter around it are ignored."""
    return F.regexp_extract(F.coalesce(c, F.lit("")), r"(?s)\{.*\}", 0)


def validate_fragments(df: DataFrame, json_col: str, doc: str = "doc_id") -> DataFrame:
    """Allowed ``(relation, tail, tail_type)`` fragments per document, deduplicated."""
    parsed = df.select(doc, F.explode(F.from_json(json_block(F.col(json_col)), FRAGMENTS)["triples"]).alias("t"))
    return (
        parsed.select(doc, "t.relation", F.trim("t.tail").alias("tail"), "t.tail_type")
        .where(
            F.col("relation").isin(*FRAGMENT_RELATIONS)
            & F.col("tail_type").isin(*TECH_TYPES)
            & (F.col("tail") != "")
        )
        .dropDuplicates([doc, "relation", "tail", "tail_type"])
    )


def validate_pairs(
    df: DataFrame, json_col: str, known_col: str, relations: Sequence[str] = PAIR_RELATIONS, doc: str = "doc_id"
) -> DataFrame:
    """Allowed directed pairs per document: both ends known names, no self-loop, deduplicated."""
    known = F.transform(F.col(known_col), lambda n: F.trim(n))
    parsed = df.select(
        doc, known.alias("known"), F.explode(F.from_json(json_block(F.col(json_col)), PAIRS)["pairs"]).alias("p")
    )
    return (
        parsed.select(doc, "known", F.trim("p.head").alias("head"), "p.relation", F.trim("p.tail").alias("tail"))
        .where(
            F.col("relation").isin(*relations)
            & (F.col("head") != "")
            & (F.col("tail") != "")
            & F.array_contains("known", F.col("head"))
            & F.array_contains("known", F.col("tail"))
            & (F.col("head") != F.col("tail"))
        )
        .select(doc, "head", "relation", "tail")
        .dropDuplicates()
    )


def pair_candidates(works: DataFrame, exclude: Sequence[str] = (), n: int | None = None, max_time: str | None = None, rows: int = 0) -> DataFrame:
    """Names of the concepts (the top ``n`` if given) of each work outside the screening list, first id per name.

    ``rows`` is the number of concepts of all works where it is known: many are shuffled once, as one row a work.
    """
    w = _works(works)
    if max_time is not None:
        w = w.where(F.coalesce("time", F.lit("")) <= max_time)
    kept = F.filter("concepts", lambda c: ~F.coalesce(tail_id(c["id"]), F.lit("")).isin(*exclude)) if exclude else F.col("concepts")
    named = F.transform(best_concepts(kept, n), lambda c, i: F.struct(F.trim(c["name"]).alias("name"), i.alias("pos"), tail_id(c["id"]).alias("cid")))
    # what is joined by document later needs no second shuffle
    by_doc = spread(w.select(F.col("head").alias("doc_id"), "time", named.alias("named")), rows, "doc_id")
    rows = by_doc.select("doc_id", "time", F.explode("named").alias("c")).select(
        "doc_id", "time", "c.name", "c.pos", "c.cid"
    ).where(F.col("cid").isNotNull() & F.col("name").isNotNull() & (F.col("name") != ""))
    return rows.groupBy("doc_id", "time", "name").agg(
        F.min_by("cid", "pos").alias("concept_id"), F.min("pos").alias("pos")
    )


def pairs_to_triples(pairs: DataFrame, candidates: DataFrame) -> DataFrame:
    """Pair names back to concept ids, dated by the work."""
    # the candidates of a document in one row, so that pairs meet them by document only
    ends = candidates.groupBy("doc_id").agg(F.collect_list(F.struct("time", "name", "concept_id")).alias("ends"))
    named = lambda end: F.explode(F.filter("ends", lambda e: e["name"] == F.col(end)))
    joined = pairs.join(ends, "doc_id").withColumn("h", named("head")).withColumn("t", named("tail"))
    return joined.select(
        F.col("h.concept_id").alias("head"),
        F.lit("Concept").alias("head_type"),
        "relation",
        F.col("t.concept_id").alias("tail"),
        F.lit("Concept").alias("tail_type"),
        F.col("h.time").alias("time"),
        F.lit("openalex").alias("source"),
    )


def clamp_tone(c: Column) -> Column:
    """Number in [-1, 1]; text that is not a number is null."""
    x = c.try_cast("double")
    return F.when(x.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)))


def attach_tone(nodes: DataFrame, tones: DataFrame) -> DataFrame:
    """Tone of news nodes from ``(id, tone)`` answers; unusable answers leave the node as it was."""
    t = tones.select("id", clamp_tone(F.col("tone")).alias("_tone")).where("_tone is not null")
    joined = nodes.join(t, "id", "left")
    new = F.when((F.col("type") == "News") & F.col("_tone").isNotNull(), F.col("_tone")).otherwise(F.col("tone"))
    return joined.withColumn("tone", new).select(*nodes.columns)


def fragments_to_triples(docs: DataFrame, fragments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fragments to quads with hashed tail ids, and the tail nodes."""
    d = docs.select("id", "doc_type", "time", F.coalesce("source", F.lit("llm")).alias("src"), "source")
    j = fragments.withColumnRenamed("doc_id", "id").join(d, "id")
    tail = fallback_id(F.col("src"), F.col("tail_type"), F.col("tail"))
    triples = j.select(
        F.col("id").alias("head"), F.col("doc_type").alias("head_type"), "relation", tail.alias("tail"), "tail_type", "time", "source"
    )
    nodes = j.select(
        tail.alias("id"),
        F.col("tail_type").alias("type"),
        F.lit(None).cast("string").alias("entity_id"),
        F.col("tail").alias("name"),
        "source",
    ).dropDuplicates(["id", "type"])
    return triples, nodes


def append_new(existing: DataFrame, batch: DataFrame, order: Column, ident: str = "id") -> DataFrame:
    """Rows of the batch whose id is not stored yet (first occurrence in the batch)."""
    return dedupe_by_id(batch, order, ident).join(existing.select(ident), ident, "left_anti")


def append_new_facts(
    existing: DataFrame, batch: DataFrame, keys: Sequence[str] = ("head", "relation", "tail", "time")
) -> DataFrame:
    """Facts of the batch not stored yet; keys compare null-safe, repeats inside the batch are kept."""
    e = existing.select(*[F.col(k).alias(f"_{k}") for k in keys])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return batch.join(e, same, "left_anti")


def backfill(works: DataFrame, lookup: DataFrame, ident: str = "id", measure: str = "cited_by_count") -> DataFrame:
    """Fill a null measure from the lookup, legal zeros stay; ``patched`` marks the rows changed."""
    new = lookup.groupBy(ident).agg(F.max(measure).alias("_new"))
    joined = works.join(new, ident, "left")
    return joined.withColumn("patched", F.col(measure).isNull() & F.col("_new").isNotNull()).withColumn(
        measure, F.coalesce(measure, "_new")
    ).drop("_new")


def as_of(df: DataFrame, key: str, ts: str, at: Column) -> DataFrame:
    """Newest version per key not later than ``at``."""
    rest = [c for c in df.columns if c != key]
    versions = df.where(F.col(ts) <= at)
    pick = F.max_by(F.struct(*rest), F.struct(ts, *[c for c in rest if c != ts]))
    return versions.groupBy(key).agg(pick.alias("_b")).select(key, "_b.*").select(*df.columns)


def with_names(df: DataFrame, named: DataFrame, order: Column, ident: str = "entity") -> DataFrame:
    """First display name per entity, empty when unknown; ``named`` has ``entity, name``."""
    names = (
        named.where(F.col("name").isNotNull() & (F.col("name") != ""))
        .groupBy("entity")
        .agg(F.min_by("name", order).alias("name"))
        .withColumnRenamed("entity", ident)
    )
    return df.join(names, ident, "left").fillna("", subset=["name"])


def valid_time(df: DataFrame, max_time: str, col: str = "time") -> DataFrame:
    """Rows with a date not after ``max_time``."""
    return df.where((F.col(col) != "") & (F.col(col) <= max_time))


def drop_concepts(df: DataFrame, ids: Sequence[str], col: str = "entity") -> DataFrame:
    return df.where(~F.col(col).isin(*ids)) if ids else df


def typed(df: DataFrame, head_types: Sequence[str], tail_types: Sequence[str]) -> DataFrame:
    return df.where(F.col("head_type").isin(*head_types) & F.col("tail_type").isin(*tail_types))
