"""Metadata filters and ownership scope, for one filter or one per query."""

from __future__ import annotations

from functools import partial, reduce
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.session import join_checked

# --- fixed values -----------------------------------------------------------
EQUAL_FIELDS = ["language", "doc_type", "listing_type", "property_type"]
# filter prefix -> metadata field
RANGE_FIELDS = {"price": "price", "bedrooms": "bedrooms", "area": "area_sqm"}
# ---------------------------------------------------------------------------

FILTERS = T.StructType(
    [T.StructField(f, T.ArrayType(T.StringType())) for f in EQUAL_FIELDS]
    + [
        T.StructField(f"{prefix}_{end}", T.DoubleType())
        for prefix in RANGE_FIELDS
        for end in ("min", "max")
    ]
)


def filters_struct(**parts: Column) -> Column:
    """Filter struct of a query row; parts left out do not restrict."""
    fields = []
    for field in FILTERS.fields:
        value = parts.get(field.name, F.lit(None))
        fields.append(value.cast(field.dataType).alias(field.name))
    return F.struct(*fields)


def apply_filters(df: DataFrame, filters: dict[str, Any], metadata: str = "metadata") -> DataFrame:
    """One filter for all rows: equality or IN, and closed ranges.

    A row without the value does not match.
    """
    tests = []
    for field in EQUAL_FIELDS:
        wanted = filters.get(field)
        if wanted:
            values = wanted if isinstance(wanted, (list, tuple)) else [wanted]
            tests.append(F.col(f"{metadata}.{field}").isin(*[str(v) for v in values]))
    for prefix, field in RANGE_FIELDS.items():
        value = F.col(f"{metadata}.{field}").cast("double")
        if filters.get(f"{prefix}_min") is not None:
            tests.append(value >= float(filters[f"{prefix}_min"]))
        if filters.get(f"{prefix}_max") is not None:
            tests.append(value <= float(filters[f"{prefix}_max"]))
    return df.filter(reduce(lambda a, b: a & b, tests)) if tests else df


def matches(filters: Column, metadata: Column) -> Column:
    """The same test with the filter in a column; a null filter lets all pass."""
    tests = []
    for field in EQUAL_FIELDS:
        wanted = filters[field]
        tests.append(wanted.isNull() | (F.size(wanted) == 0) | F.array_contains(wanted, metadata[field]))
    for prefix, field in RANGE_FIELDS.items():
        value = metadata[field].cast("double")
        low, high = filters[f"{prefix}_min"], filters[f"{prefix}_max"]
        tests.append(low.isNull() | (value >= low))
        tests.append(high.isNull() | (value <= high))
    return filters.isNull() | F.coalesce(reduce(lambda a, b: a & b, tests), F.lit(False))


def visible(user: Column, session: Column, owner: Column) -> Column:
    """Public rows, or rows of a session the user owns."""
    return session.isNull() | F.coalesce(owner == user, F.lit(False))


def with_owner(chunks: DataFrame, sessions: DataFrame) -> DataFrame:
    """Adds the user owning the chunk's session, null for the public corpus.

    Public rows skip the join: they are most of the corpus and share one null key.
    """
    owners = sessions.select("session_id", F.col("user_id").alias("owner"))
    public = chunks.filter("session_id IS NULL").withColumn("owner", F.lit(None).cast("string"))
    private = chunks.filter("session_id IS NOT NULL").join(owners, "session_id", "left")
    return public.unionByName(private)


def ownership_scope(chunks: DataFrame, sessions: DataFrame, user: str | None) -> DataFrame:
    """Chunks one user may see; only the public corpus without a user."""
    public = chunks.filter("session_id IS NULL")
    if user is None:
        return public
    own = sessions.filter(F.col("user_id") == user).select("session_id")
    return public.unionByName(
        chunks.filter("session_id IS NOT NULL").join(own, "session_id", "left_semi").select(*chunks.columns)
    )


def filtered_pairs(
    pairs: DataFrame, queries: DataFrame, chunks: DataFrame, *, queries_fit: bool | None = None
) -> DataFrame:
    """Keeps (query_id, chunk_id) pairs whose chunk passes that query's filter and scope."""
    wanted = queries.select("query_id", "user_id", "filters")
    facts = chunks.select("chunk_id", "metadata", "session_id", "owner")
    judged = join_checked(pairs.join(facts, "chunk_id"), wanted, "query_id", small_fits=queries_fit)
    return judged.filter(
        matches(F.col("filters"), F.col("metadata"))
        & visible(F.col("user_id"), F.col("session_id"), F.col("owner"))
    ).select(*pairs.columns)


def _holds(value: Column, wanted: Any) -> Column:
    """JSON containment of ``wanted`` in a variant; false, never null, where the types differ."""
    kind = F.schema_of_variant(value)
    if isinstance(wanted, dict):
        # Keys are looked up as they are, not read as paths.
        fields = F.try_variant_get(value, "$", "map<string,variant>")
        tests = [kind.startswith("OBJECT")]
        tests += [_holds(F.try_element_at(fields, F.lit(name)), part) for name, part in wanted.items()]
    elif isinstance(wanted, list):
        items = F.try_variant_get(value, "$", "array<variant>")
        tests = [kind.startswith("ARRAY")]
        tests += [F.exists(items, partial(_holds_item, part)) for part in wanted]
    elif wanted is None:
        tests = [kind == "VOID"]
    elif isinstance(wanted, bool):
        tests = [kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean") == F.lit(wanted)]
    elif isinstance(wanted, (int, float)):
        tests = [kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(value, "$", "double") == F.lit(float(wanted))]
    else:
        tests = [kind == "STRING", F.try_variant_get(value, "$", "string") == F.lit(wanted)]
    return F.coalesce(reduce(lambda a, b: a & b, tests), F.lit(False))


def _holds_item(wanted: Any, item: Column) -> Column:
    return _holds(item, wanted)


def contains(df: DataFrame, wanted: dict[str, Any], column: str) -> DataFrame:
    """JSON containment: every given field, at any depth, is there with that value and JSON type.

    Lists are contained when each of their items is contained in some item; an
    empty object is contained in every object; null matches a null that is there.
    """
    parsed = df.withColumn("__json", F.try_parse_json(F.col(column)))
    return parsed.filter(_holds(F.col("__json"), wanted)).drop("__json")


class PairRules:
    """The same filter and scope tests over Arrow batches inside a task.

    Queries with equal filter and user share one rule, so a batch is tested
    once per distinct rule, not once per query.
    """

    def __init__(self, filters: bool = False, scope: bool = False, other_session: bool = False) -> None:
        self.filters = filters
        self.scope = scope
        # Items of the query's own session do not compete.
        self.other_session = other_session

    @property
    def query_columns(self) -> list[str]:
        return (
            (["filters"] if self.filters else [])
            + (["user_id"] if self.scope else [])
            + (["session_id"] if self.other_session else [])
        )

    @property
    def item_columns(self) -> list[str]:
        return (
            (["metadata"] if self.filters else [])
            + (["session_id", "owner"] if self.scope else [])
            + (["session_id"] if self.other_session else [])
        )

    def group(self, table: pa.Table) -> tuple[list[dict[str, Any]], np.ndarray]:
        """Distinct rules of the queries, and the rule number of each query."""
        seen: dict[str, int] = {}
        rules: list[dict[str, Any]] = []
        of = np.zeros(table.num_rows, dtype=np.int64)
        if self.query_columns:
            for row, rule in enumerate(table.select(self.query_columns).to_pylist()):
                key = repr(rule)
                if key not in seen:
                    seen[key] = len(rules)
                    rules.append(rule)
                of[row] = seen[key]
        return (rules or [{}]), of

    def masks(self, rules: list[dict[str, Any]], items: pa.RecordBatch | pa.Table) -> np.ndarray:
        """Boolean matrix, one row per rule, one column per item."""
        out = np.ones((len(rules), items.num_rows), dtype=bool)
        if items.num_rows == 0:
            return out

        def column(name: str) -> Any:
            got = items.column(name)
            return got.combine_chunks() if isinstance(got, pa.ChunkedArray) else got

        meta = column("metadata") if self.filters else None
        for at, rule in enumerate(rules):
            wanted = rule.get("filters") or {}
            for field in EQUAL_FIELDS:
                if wanted.get(field):
                    values = pa.array(wanted[field], pa.string())
                    found = pc.is_in(pc.struct_field(meta, field), value_set=values)
                    out[at] &= found.to_numpy(zero_copy_only=False)
            for prefix, field in RANGE_FIELDS.items():
                for end, test in (("min", pc.greater_equal), ("max", pc.less_equal)):
                    bound = wanted.get(f"{prefix}_{end}")
                    if bound is not None:
                        value = pc.cast(pc.struct_field(meta, field), pa.float64())
                        out[at] &= pc.fill_null(test(value, bound), False).to_numpy(zero_copy_only=False)
            if self.scope:
                public = pc.is_null(column("session_id"))
                user = rule.get("user_id")
                if user is not None:
                    mine = pc.fill_null(pc.equal(column("owner"), user), False)
                    public = pc.or_(public, mine)
                out[at] &= public.to_numpy(zero_copy_only=False)
        if self.other_session:
            # Sessions as numbers: one comparison of two columns instead of one scan per rule.
            coded = column("session_id").dictionary_encode()
            place = {v: n for n, v in enumerate(coded.dictionary.to_pylist())}
            own = np.array([place.get(rule.get("session_id"), -2) for rule in rules], dtype=np.int64)
            of_item = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False)
            out &= own[:, None] != of_item[None, :]
        return out
