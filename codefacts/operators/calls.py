"""Calls: how their values are used, and what is wrong with that."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codefacts.operators.rules import DANGEROUS, FORMAT, FORMAT_INDEX, MUST_CHECK, category

STORES = ("assignment_expression", "init_declarator")


def usage_status() -> Column:
    """The status of a call from the syntax around it; the first rule that holds decides."""
    e, p = F.col("e_kind"), F.col("p_kind")
    return (
        F.when(p.isNull(), "unchecked")
        .when(e.isin(*STORES) | p.isin(*STORES), "stored")
        .when((p == "expression_statement") & F.col("void_cast"), "ignored_explicit")
        .when(p == "expression_statement", "unchecked")
        .when(F.col("in_condition"), "checked_cond")
        .when(p == "return_statement", "propagated")
        .otherwise("stored")
    )


def has_flag(bit: int) -> Column:
    return F.col("flags").bitwiseAND(bit) != 0


def open_format() -> Column:
    """A format argument is there and is no single literal."""
    known = F.create_map(*[F.lit(x) for pair in FORMAT_INDEX.items() for x in pair])
    n = F.size("arg_kinds")
    at = F.coalesce(known[F.col("function")], F.when(n == 1, 0).otherwise(1))
    return has_flag(FORMAT) & (n > at) & (F.coalesce(F.get("arg_kinds", at), F.lit("")) != "string_literal")


def ruled_calls(events: DataFrame, rules: DataFrame) -> DataFrame:
    """Every call of a function that has a rule, with flags, status, category and whether it is a diagnostic."""
    calls = events.where("kind = 'call'").drop("kind", "func_id", "var", "terminal").join(rules.select(F.col("name").alias("function"), "flags"), "function")
    lost = has_flag(MUST_CHECK) & F.col("store_var").isNotNull() & F.col("in_block") & ~F.col("checked_later")
    status = F.when((F.col("status") == "stored") & lost, "stored_unchecked").otherwise(F.col("status"))
    calls = calls.withColumn("status", usage_status()).withColumn("status", status)
    unread = has_flag(MUST_CHECK) & F.col("status").isin("unchecked", "ignored_explicit")
    verdict = (
        F.when(has_flag(DANGEROUS), "dangerous_function")
        .when(open_format(), "format_string")
        .when(unread, "retval_unchecked")
        .when(has_flag(MUST_CHECK) & (F.col("status") == "stored_unchecked"), "return_value_check")
    )
    return calls.withColumn("category", category(F.col("flags"))).withColumn("verdict", verdict)


def call_findings(ruled: DataFrame) -> DataFrame:
    """One finding at most for each call; see ruled_calls for the order of verdicts."""
    f, v = F.col("function"), F.col("verdict")
    message = (
        F.when(v == "dangerous_function", F.concat(F.lit("warning: use of dangerous function "), f, F.lit("()")))
        .when(v == "format_string", F.concat(F.lit("warning: non-literal format string in "), f, F.lit("()")))
        .when(v == "retval_unchecked", F.concat(F.lit("unchecked return value of "), f, F.lit("()")))
        .when(v == "return_value_check", F.concat(F.lit("stored but unchecked return value of "), f, F.lit("()")))
    )
    return ruled.where(v.isNotNull()).select(
        "file_idx", "path", F.col("seq").cast("long").alias("seq"), "line", "column", f.substr(1, 63).alias("symbol"),
        F.when(v == "retval_unchecked", "return_value_check").otherwise(v).alias("category"), v.alias("kind"), message.alias("message"), (v == "retval_unchecked").alias("issue_format"),
    )
