"""Documentation pages: sections, metadata, aliases, and the store that keeps them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codefacts.functions.text import trimmed

#: 1 to 40 characters, a letter among them, no lower case: a section's title.
TITLE = r"^(?=.{1,40}$)(?=.*[A-Z])[A-Z0-9\p{Punct} \t]+$"


def is_title(line: Column) -> Column:
    return trimmed(line, " \t").rlike(TITLE)


def page_sections(pages: DataFrame, key: list[str], text: str = "raw") -> DataFrame:
    """(key, ord, section_name, content): each title starts a section; what stands before the first is left out.

    The running number of titles within a page numbers the sections, so pages are dealt out by key.
    """
    lines = pages.select(*key, F.posexplode(F.split(text, "\n")).alias("pos", "line")).withColumn("title", is_title(F.col("line")))
    numbered = lines.withColumn("ord", F.sum(F.col("title").cast("int")).over(Window.partitionBy(*key).orderBy("pos")) - 1).where("ord >= 0")
    body = F.transform(F.array_sort(F.collect_list(F.when(~F.col("title"), F.struct("pos", "line")))), lambda x: x["line"])
    grouped = numbered.groupBy(*key, F.col("ord").cast("int").alias("ord")).agg(F.max(F.when(F.col("title"), trimmed(F.col("line"), " \t"))).alias("section_name"), trimmed(F.array_join(body, "\n")).alias("content"))
    return grouped.select(*key, "ord", "section_name", "content")


def split_first(line: Column, separator: str = " - ") -> tuple[Column, Column]:
    """What stands before and after the first separator; without one, the whole line and null."""
    at = F.instr(line, separator)
    return F.when(at > 0, trimmed(F.substring_index(line, separator, 1))).otherwise(trimmed(line)), F.when(at > 0, trimmed(F.substr(line, at + len(separator))))


def first_line(text: Column) -> Column:
    """The first line that is not blank, without blanks around it."""
    return F.get(F.filter(F.transform(F.split(text, "\n"), lambda x: trimmed(x, " \t")), lambda x: x != ""), F.lit(0))


def header_of(synopsis: Column) -> Column:
    """The included file of a synopsis: <...> if both signs come in this order on or after the first line with text, else that line."""
    rest = F.regexp_extract(synopsis, r"(?s)[ \t\n]*(.*)", 1)
    lt, gt = F.instr(rest, "<"), F.instr(rest, ">")
    return F.when(rest.contains("#include"), F.when((lt > 0) & (gt > lt), F.substr(rest, lt, gt - lt + 1)).otherwise(first_line(synopsis)))


def prototype_of(synopsis: Column) -> Column:
    """The first line with text of a synopsis that has parentheses from there on."""
    lines = F.filter(F.transform(F.split(synopsis, "\n"), lambda x: trimmed(x, " \t")), lambda x: x != "")
    rest = lambda k: F.array_join(F.slice(lines, k + 1, F.size(lines)), "\n")
    at = F.filter(F.sequence(F.lit(0), F.greatest(F.size(lines) - 1, F.lit(0))), lambda k: rest(k).contains("(") & rest(k).contains(")"))
    return F.get(lines, F.coalesce(F.get(at, F.lit(0)), F.lit(-1)))


def page_metadata(sections: DataFrame, key: list[str]) -> DataFrame:
    """(key, short_name, short_desc, header, proto) from the first NAME section with text and the first SYNOPSIS."""
    named = F.min(F.when((F.col("section_name") == "NAME") & (first_line(F.col("content")).isNotNull()), F.struct("ord", "content")))["content"]
    synopsis = F.min(F.when(F.col("section_name") == "SYNOPSIS", F.struct("ord", "content")))["content"]
    found = sections.groupBy(*key).agg(named.alias("_name"), synopsis.alias("_synopsis"))
    name, described = split_first(first_line(F.col("_name")))
    return found.select(*key, name.alias("short_name"), described.alias("short_desc"), header_of(F.col("_synopsis")).alias("header"), prototype_of(F.col("_synopsis")).alias("proto"))


def aliases_of(name: Column, short_name: Column) -> Column:
    """All names of a page: its own, then those of the comma list, without blanks, each once."""
    listed = F.transform(F.split(F.coalesce(short_name, F.lit("")), ","), lambda x: trimmed(x, " \t"))
    return F.array_distinct(F.filter(F.concat(F.array(name), listed), lambda x: x != ""))


def parse_pages(pages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(functions, sections, aliases) of pages(name, section, raw), keyed by name and section."""
    key = ["name", "section"]
    sections = page_sections(pages, key)
    functions = pages.join(page_metadata(sections, key), key, "left").select(*key, "short_name", "short_desc", "header", "proto", F.lit(None).cast("string").alias("man_source"), "raw")
    aliases = functions.select(*key, F.explode(aliases_of(F.col("name"), F.col("short_name"))).alias("alias_name"))
    return functions, sections, aliases


def latest(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """Of each key the row that comes first in the order: an upsert's outcome."""
    return rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_nth = 1").drop("_nth")


def replace_children(existing: DataFrame, new: DataFrame, touched: DataFrame, key: str) -> DataFrame:
    """Children of untouched parents, and the new ones."""
    return existing.join(touched.select(key).distinct(), key, "left_anti").select(new.columns).unionByName(new)


def dense_numbers(rows: DataFrame, key: list[str], name: str, parts: int = 256) -> DataFrame:
    """rows with the numbers 1, 2, ... in some fixed order of the distinct key, counted in parts, so that no task sees all rows."""
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64(*key), F.lit(parts)))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*key))
    return dealt.withColumn(name, own).join(F.broadcast(starts), "_part").withColumn(name, F.col(name) + F.col("_before")).drop("_part", "_before")  # at most `parts` rows


def upsert(store: tuple[DataFrame, DataFrame, DataFrame], batch: tuple[DataFrame, DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The store (functions, function_sections, function_aliases) after a batch of parse_pages.

    A page that is there keeps its id, its other columns and its children are replaced; pages that the batch
    does not list stay. New ids follow the largest one without gaps.
    """
    functions, sections, aliases = store
    new_functions, new_sections, new_aliases = batch
    key = ["name", "section"]
    new_functions = latest(new_functions, key, ["raw"])
    ids = functions.select("id", *key)
    top = F.broadcast(functions.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")))  # one row
    fresh = new_functions.select(*key).join(ids, key, "left_anti")
    numbered = dense_numbers(fresh, key, "n").crossJoin(top).select((F.col("n") + F.col("top")).alias("id"), *key)
    all_ids = ids.join(new_functions.select(*key), key, "left_semi").unionByName(numbered)
    put = new_functions.join(all_ids, key)
    touched = all_ids.select(F.col("id").alias("function_id"))
    out_functions = functions.join(new_functions.select(*key), key, "left_anti").select(functions.columns).unionByName(put.select(functions.columns))
    child = lambda rows: rows.join(all_ids, key).withColumnRenamed("id", "function_id")
    put_sections = child(new_sections).select("function_id", "section_name", "content", "ord")
    put_aliases = child(new_aliases).select("function_id", "alias_name").dropDuplicates(["alias_name", "function_id"])
    return out_functions, _numbered(replace_children(sections, put_sections, touched, "function_id"), ["function_id", "ord"]), _numbered(replace_children(aliases, put_aliases, touched, "function_id"), ["function_id", "alias_name"])


def delete_pages(store: tuple[DataFrame, DataFrame, DataFrame], gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The store without the functions whose ids are in gone(id), and without their children."""
    functions, sections, aliases = store
    parents = gone.select(F.col("id").alias("function_id")).distinct()
    return functions.join(gone.select("id").distinct(), "id", "left_anti"), sections.join(parents, "function_id", "left_anti").select(sections.columns), aliases.join(parents, "function_id", "left_anti").select(aliases.columns)


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """An id for each child; unique, not dense, so that no task has to see all rows."""
    return rows.withColumn("id", F.xxhash64(*order)).select("id", *rows.columns)


def lookup(names: DataFrame, functions: DataFrame, sections: DataFrame, aliases: DataFrame) -> DataFrame:
    """For asked (name, section): the page of that name, else one that has it as an alias (the least id), with its sections in order."""
    asked = names.select("name", "section").distinct()
    direct = asked.join(functions.select("id", "name", "section"), ["name", "section"]).select("name", "section", F.lit(0).alias("prio"), "id")
    by_alias = aliases.join(functions.select(F.col("id").alias("function_id"), "section"), "function_id").select(F.col("alias_name").alias("name"), "section", F.lit(1).alias("prio"), F.col("function_id").alias("id"))
    found = latest(direct.unionByName(asked.join(by_alias, ["name", "section"]).select("name", "section", "prio", "id")), ["name", "section"], ["prio", "id"])
    listed = sections.join(found.select(F.col("id").alias("function_id")).distinct(), "function_id", "left_semi").groupBy(F.col("function_id").alias("id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ord", "section_name", "content"))), lambda s: F.struct(s["section_name"].alias("name"), s["content"].alias("content"), s["ord"].alias("order_index"))).alias("sections")
    )
    facts = functions.select("id", F.col("name").alias("page_name"), "short_name", "short_desc", "header", "proto", "man_source", "raw")
    return found.drop("prio").join(facts, "id").join(listed, "id", "left")
