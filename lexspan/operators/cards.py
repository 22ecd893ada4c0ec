"""Knowledge units as facts, card meanings, selection texts and guides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import identity, text as T

#: Ceilings on the lists of a card, and the facts that people wrote, most telling first.
KEYWORDS, KEYWORD_UNITS, ALIASES, ALIAS_UNITS = 64, 64, 32, 128
HUMAN_FACTS = ("section_label", "document_title", "section_path", "keywords_derived")
CARD_UNITS, QUERY_UNITS = 2048, 480


def taken(groups: list[Column], count: int, each: int) -> Column:
    """Entries of the groups in order, without repeats and over-long ones, up to the count; then sorted."""
    every = F.filter(F.flatten(F.array(*groups)), lambda x: (x != "") & (T.utf16_units(x) <= each))
    return F.array_sort(F.slice(F.array_distinct(every), 1, count))


def _tokens(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.transform(c, T.meaning_tokens))))


def meanings(units: DataFrame) -> DataFrame:
    """unit_id, document_id and description, questions, aliases, keywords of document units.

    units: unit_id, document_id and each of HUMAN_FACTS as an array of texts.
    """
    facts = F.array_compact(F.array(*[F.when(F.size(f) > 0, F.concat(F.lit(f.replace("_", ".", 1) + ": "), F.array_join(f, ", "))) for f in HUMAN_FACTS]))
    subject = F.concat(F.lit("Semantic unit "), F.col("unit_id"), F.lit(" of document "), F.col("document_id"), F.lit("."))
    return units.select(
        "unit_id",
        "document_id",
        F.when(F.size(facts) > 0, F.concat_ws(" ", subject, F.array_join(facts, " · "))).otherwise(subject).alias("description"),
        F.array(F.concat(F.lit("What does "), F.col("document_id"), F.lit(" say in "), F.col("unit_id"), F.lit("?"))).alias("questions"),
        taken([F.array_sort(F.array_distinct(F.array("document_id", "unit_id"))), F.col("section_label"), F.col("document_title")], ALIASES, ALIAS_UNITS).alias("aliases"),
        taken([_tokens(F.col(f)) for f in HUMAN_FACTS], KEYWORDS, KEYWORD_UNITS).alias("keywords"),
    )


def selection_texts(cards: DataFrame) -> DataFrame:
    """version_id, selection_text, digest, units, fits: the text that a card is embedded by, its lists sorted and without repeats.

    The description's line stands even if it is empty; only entries of lists are left out.
    """
    lists = [T.normal_list(F.col(c)) for c in ("questions", "aliases", "keywords")]
    text = F.concat(T.collapsed(F.col("description")), F.lit("\n"), F.array_join(F.concat(*lists), "\n"))
    s = cards.select("version_id", text.alias("selection_text"))
    return s.select("version_id", "selection_text", T.digest(F.col("selection_text")).alias("digest"), T.units(F.col("selection_text")).alias("units"), (T.units(F.col("selection_text")) <= CARD_UNITS).alias("fits"))


def guides(scopes: DataFrame) -> DataFrame:
    """scope_id, guide (JSON) and managed: documents are read here, SQL tables and HTTP operations by the caller.

    scopes: scope_id, kind, document_id, unit_ids, connector, schema_name, table_name, columns, method, path.
    """
    g = (
        F.when(F.col("kind") == "managed_document", F.to_json(F.struct("kind", "document_id", F.array_sort("unit_ids").alias("unit_ids"))))
        .when(F.col("kind") == "sql_source", F.to_json(F.struct("kind", "connector", "schema_name", "table_name", F.array_sort("columns").alias("columns"))))
        .when(F.col("kind") == "http_source", F.to_json(F.struct("kind", "connector", "method", "path")))
        .otherwise(F.raise_error(F.concat(F.lit("no guide for a scope of kind "), F.coalesce("kind", F.lit("null")))).cast("string"))
    )
    return scopes.select("scope_id", g.alias("guide"), (F.col("kind") == "managed_document").alias("managed"))


def unit_violations(units: DataFrame, most_facts: int = 64, most_bytes: int = 16_384) -> DataFrame:
    """publication_id, unit_id and problem of what a unit breaks by itself. units: publication_id, unit_id, content, content_digest, n_facts, fact_bytes, scopes (array)."""
    checks = {
        "digest": ~F.col("content_digest").eqNullSafe(T.digest(F.col("content"))),
        "too_many_facts": F.col("n_facts") > most_facts,
        "facts_too_large": F.col("fact_bytes") > most_bytes,
        "scopes_not_sorted": ~T.sorted_unique(F.col("scopes")),
        "no_scope": F.size("scopes") == 0,
    }
    return units.select("publication_id", "unit_id", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in checks.items()]))).alias("problem"))


def publication_violations(units: DataFrame, most_units: int = 10_000, most_facts: int = 64, most_bytes: int = 16_384) -> DataFrame:
    """unit_violations, and what a publication breaks as a whole: repeated units, and too many of them (unit_id is null)."""
    own = unit_violations(units, most_facts, most_bytes)
    twice = units.groupBy("publication_id", "unit_id").count().where("count > 1").select("publication_id", "unit_id", F.lit("repeated_unit").alias("problem"))
    large = units.groupBy("publication_id").count().where(F.col("count") > most_units).select("publication_id", F.lit(None).cast(units.schema["unit_id"].dataType).alias("unit_id"), F.lit("too_many_units").alias("problem"))
    return own.unionByName(twice).unionByName(large)


def unchanged_units(previous: DataFrame, current: DataFrame) -> DataFrame:
    """unit_id of units whose set of chunk revisions is the same in both: their scopes are inherited. Both: unit_id, revision."""
    sets = lambda df, name: df.groupBy("unit_id").agg(F.array_sort(F.collect_set("revision")).alias(name))
    return sets(previous, "p").join(sets(current, "c"), "unit_id").where("p = c").select("unit_id")


def chunk_bindings(chunks: DataFrame) -> DataFrame:
    """index_id, record_set_digest and n of each index, whatever the order of its records. chunks: index_id, revision, digest."""
    return chunks.groupBy("index_id").agg(identity.set_digest(F.collect_list(F.concat_ws(":", "revision", "digest"))).alias("record_set_digest"), F.count("*").alias("n"))
