"""Deeply nested JSON records into related flat tables.

The payload is parsed once into a VARIANT; nested `transform` calls attach the ancestors' keys and zero-based indexes,
`flatten` combines the arrays and one `inline` per target table emits its rows. There is no shuffle and no Python: each
input row gives its child rows where it is read, so the plan is a scan, a projection and a generator.

Defined results: a null or broken payload gives no row anywhere; a missing, null or empty array gives no child row; a
single value in place of an array is its element 0; a null element gives no row but keeps its index; JSON given as a
string is parsed where a container is expected; snake_case and camelCase keys and one level of envelope are accepted;
repeated input rows give repeated output rows; extra columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

#: Keys under which a record may be wrapped.
ENVELOPES = ("row", "record", "data", "payload", "item")


def _camel(name: str) -> str:
    first, *rest = name.split("_")
    return first + "".join(x.capitalize() for x in rest)


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once: nested helpers stay linear in size."""
    return F.element_at(F.transform(F.array(value), use), 1)


def field(v: Column, name: str) -> Column:
    """A member under its snake_case or camelCase key; JSON null counts as absent."""
    keys = list(dict.fromkeys((name, _camel(name))))
    found = let(v, lambda x: F.coalesce(*(F.try_variant_get(x, f"$.{k}", "variant") for k in keys)))
    return let(found, lambda x: F.when(~F.is_variant_null(x), x))


def unstring(v: Column) -> Column:
    """A container given as JSON text becomes that container; anything else stays."""
    def of(x: Column) -> Column:
        parse = let(F.try_variant_get(x, "$", "string"), lambda t: F.when(t.rlike(r"^\s*[\[{]"), F.try_parse_json(t)))
        return F.when(_kind(x) == "STRING", F.coalesce(parse, x)).otherwise(x)

    return let(v, of)


def items(v: Column) -> Column:
    """The elements as ARRAY<VARIANT>; a single value is one element, an absent one none."""
    none = F.array().cast("array<variant>")
    return let(unstring(v), lambda x: F.when(x.isNull() | F.is_variant_null(x), none).when(_kind(x).startswith("ARRAY"), F.try_variant_get(x, "$", "array<variant>")).otherwise(F.array(x)))


def indexed(array: Column, make: Callable[[Column, Column], Column]) -> Column:
    """make(element, index) of each element that is not null, in order, with its index in the whole array."""
    pairs = F.transform(array, lambda e, i: F.struct(i.alias("i"), e.alias("e")))
    there = F.filter(pairs, lambda p: p["e"].isNotNull() & ~F.is_variant_null(p["e"]))
    return F.transform(there, lambda p: make(p["e"], p["i"]))


def _text(v: Column) -> Column:
    """Strings as they are, anything else as JSON."""
    return let(v, lambda x: F.when(_kind(x) == "STRING", F.try_variant_get(x, "$", "string")).otherwise(F.to_json(x)))


def parsed(df: DataFrame, id_col: str = "raw_id", payload: str = "payload") -> DataFrame:
    """raw_id, instruction_sha256 and the record's parts as VARIANT, of each payload that is a JSON object."""
    whole = F.try_parse_json(F.concat(F.lit("["), F.col(payload), F.lit("]")))  # in brackets, as the parser stops after a first value
    one = F.when(F.try_variant_get(whole, "$[1]", "variant").isNull(), F.try_variant_get(whole, "$[0]", "variant"))
    root = df.select(F.col(id_col).alias("raw_id"), one.alias("v")).where(F.col("v").isNotNull() & F.schema_of_variant("v").startswith("OBJECT"))
    inner = F.coalesce(*(F.try_variant_get("v", f"$.{k}", "variant") for k in ENVELOPES))
    own = F.coalesce(field(F.col("v"), "prompt"), field(F.col("v"), "reward_model"), field(F.col("v"), "extra_info"))
    record = root.select("raw_id", unstring(F.when(own.isNull(), F.coalesce(inner, F.col("v"))).otherwise(F.col("v"))).alias("v"))
    extra = record.select("raw_id", "v", unstring(field(F.col("v"), "extra_info")).alias("extra"))
    return extra.select(
        "raw_id",
        F.try_variant_get(field(F.col("extra"), "instruction_sha256"), "$", "string").alias("instruction_sha256"),
        field(F.col("v"), "prompt").alias("prompt"),
        unstring(field(unstring(field(F.col("v"), "reward_model")), "ground_truth")).alias("gt"),
        "extra",
    )


def _tool_calls(m: Column) -> Column:
    return items(field(m, "tool_calls"))


def _steps(gt: Column) -> Column:
    return items(field(unstring(field(gt, "evidence_plan")), "steps"))


def _gold(gt: Column) -> Column:
    """The expected rows: an array, a single object as one row; a plain number or text gives none."""
    tabular = lambda v: let(v, lambda x: F.when(_kind(x).startswith("ARRAY") | _kind(x).startswith("OBJECT"), x))
    return let(gt, lambda g: items(F.coalesce(tabular(unstring(field(g, "expected_value"))), tabular(unstring(field(g, "expected_value_json"))))))


def _emit(df: DataFrame, rows: Column) -> DataFrame:
    return df.select("raw_id", "instruction_sha256", rows.alias("_rows")).select("raw_id", "instruction_sha256", F.inline("_rows"))


def messages(p: DataFrame) -> DataFrame:
    return _emit(p, indexed(items(F.col("prompt")), lambda m, i: F.struct(i.alias("message_index"), _text(field(m, "role")).alias("role"), _text(field(m, "content")).alias("content"), _text(field(m, "tool_call_id")).alias("tool_call_id"))))


def tool_calls(p: DataFrame) -> DataFrame:
    def calls(m: Column, i: Column) -> Column:
        return indexed(_tool_calls(m), lambda c, j: F.struct(i.alias("message_index"), j.alias("call_index"), _text(field(c, "id")).alias("call_id"), _text(field(c, "name")).alias("name"), F.to_json(field(c, "arguments")).alias("arguments")))

    return _emit(p, F.flatten(indexed(items(F.col("prompt")), calls)))


def _scalars(name: str, column: str) -> Callable[[DataFrame], DataFrame]:
    def of(p: DataFrame) -> DataFrame:
        return _emit(p, indexed(items(field(F.col("gt"), name)), lambda e, i: F.struct(i.alias("item_index"), _text(e).alias(column))))

    return of


required_tables, must_use_fields = _scalars("required_tables", "table_name"), _scalars("must_use_fields", "field_name")


def evidence_steps(p: DataFrame) -> DataFrame:
    return _emit(p, indexed(_steps(F.col("gt")), lambda s, i: F.struct(i.alias("step_index"), _text(field(s, "step")).alias("step"), _text(field(s, "table")).alias("table_name"))))


def evidence_fields(p: DataFrame) -> DataFrame:
    def fields(s: Column, i: Column) -> Column:
        return indexed(items(field(s, "fields")), lambda f, j: F.struct(i.alias("step_index"), j.alias("field_index"), _text(field(f, "name")).alias("name"), _text(field(f, "agg")).alias("agg")))

    return _emit(p, F.flatten(indexed(_steps(F.col("gt")), fields)))


def gold_rows(p: DataFrame) -> DataFrame:
    return _emit(p, indexed(_gold(F.col("gt")), lambda r, i: F.struct(i.alias("row_index"), _text(field(r, "category")).alias("category"), F.try_variant_get(field(r, "value"), "$", "double").alias("value"), F.to_json(r).alias("row_json"))))


def records(p: DataFrame) -> DataFrame:
    gt, text = F.col("gt"), lambda v, n: _text(field(v, n)).alias(n)
    return p.select("raw_id", "instruction_sha256", text(gt, "task_id"), text(gt, "environment_id"), text(gt, "answer_type"), text(gt, "verification_sql"), text(F.col("extra"), "source_label"))


#: Target tables by name; each child row leads back by raw_id, instruction_sha256 and its indexes.
TABLES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "record": records, "message": messages, "tool_call": tool_calls, "required_table": required_tables, "must_use_field": must_use_fields, "evidence_step": evidence_steps, "evidence_field": evidence_fields, "gold_row": gold_rows,
}


def flat(df: DataFrame, name: str, id_col: str = "raw_id", payload: str = "payload") -> DataFrame:
    """One of TABLES from raw records."""
    return TABLES[name](parsed(df, id_col, payload))


def elements(p: DataFrame) -> DataFrame:
    """(raw_id, entity, pos) of every element of every nested array, from one pass over the records."""
    def at(entity: str, *index: Column) -> Column:
        return F.struct(F.lit(entity).alias("entity"), F.concat_ws(".", *(i.cast("string") for i in index)).alias("pos"))

    prompt, gt = items(F.col("prompt")), F.col("gt")
    return p.select(
        "raw_id",
        F.inline(
            F.concat(
                indexed(prompt, lambda m, i: at("message", i)),
                F.flatten(indexed(prompt, lambda m, i: indexed(_tool_calls(m), lambda c, j: at("tool_call", i, j)))),
                indexed(items(field(gt, "required_tables")), lambda e, i: at("required_table", i)),
                indexed(items(field(gt, "must_use_fields")), lambda e, i: at("must_use_field", i)),
                indexed(_steps(gt), lambda s, i: at("evidence_step", i)),
                F.flatten(indexed(_steps(gt), lambda s, i: indexed(items(field(s, "fields")), lambda f, j: at("evidence_field", i, j)))),
                indexed(_gold(gt), lambda r, i: at("gold_row", i)),
            )
        ),
    )


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every element of a nested array of a record that parses."""
    return elements(parsed(table(spark, sf_dir, "raw_record")))


def p5_table(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: flat(table(spark, sf_dir, "raw_record"), name)
