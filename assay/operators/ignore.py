"""Ignore rules over path tables: the last matching rule decides, and a dropped directory drops its subtree.

Paths are relative to the scan root; ``RULE`` rows carry the directory their file was
found in. Two exact ways, chosen by the number of rules: a few are compiled into one
expression and cost no shuffle at all; many are joined to the paths.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from assay.functions.globs import parse_ignore_rule
from assay.functions.paths import ancestors, parent_dir
from assay.plans.skew import COPIES, spread_join

#: Up to this many rules become one expression.
COMPILED_RULES = 200


def rules_from_lines(lines: DataFrame) -> DataFrame:
    """RULE rows of ``(base_path, line_no, value)``; blanks and comments fall away."""
    parsed = lines.withColumn("rule", parse_ignore_rule(F.col("value"), F.col("line_no")))
    return parsed.filter("rule.regex IS NOT NULL").select(
        "base_path", F.col("line_no").cast("int").alias("rule_seq"), "rule.*"
    )


def append_rules(parent: DataFrame, child: DataFrame) -> DataFrame:
    """Both rule sets in the order they apply: outer directories first, then by line."""
    return parent.unionByName(child).orderBy(_depth(F.col("base_path")), "base_path", "rule_seq")


def _depth(base: Column) -> Column:
    return F.when(base == "", 0).otherwise(F.size(F.split(base, "/")))


def apply_ignore_rules(entries: DataFrame, rules: DataFrame, compiled_rules: int = COMPILED_RULES) -> DataFrame:
    """Entries ``(path, is_dir, ...)`` that survive the rules."""
    known = rules.limit(compiled_rules + 1).collect()
    if not known:
        return entries
    if len(known) <= compiled_rules:
        verdict = compile_rules(known)
        above = F.exists(ancestors(F.col("path")), lambda p: verdict(p, F.lit(True)))
        return entries.filter(~(above | verdict(F.col("path"), F.col("is_dir"))))
    return _apply_by_join(entries, rules)


def compile_rules(rules: list):
    """A function ``(path, is_dir) -> ignored`` over a bounded list of RULE rows."""
    ordered = sorted(rules, key=lambda r: (len(r.base_path.split("/")) if r.base_path else 0, r.rule_seq))

    def ignored(path: Column, is_dir: Column) -> Column:
        name = F.substring_index(path, "/", -1)

        def matches(rule) -> Column:
            candidate = name
            if rule.path_pattern:
                skipped = len(rule.base_path) + 1 if rule.base_path else 0
                candidate = F.substring(path, F.lit(skipped + 1), F.length(path)) if skipped else path
            tests = [candidate.rlike(rule.regex)]
            if rule.base_path:
                tests.insert(0, path.startswith(rule.base_path + "/"))
            if rule.dir_only:
                tests.insert(0, is_dir)
            return reduce(Column.__and__, tests)

        # Later rules win, so the first hit from the end decides.
        out = None
        for rule in reversed(ordered):
            out = (F if out is None else out).when(matches(rule), F.lit(not rule.negated))
        return out.otherwise(False)

    return ignored


def ignore_rule_join(paths: DataFrame, rules: DataFrame, copies: int = COPIES) -> DataFrame:
    """``(path, is_dir, base_path, rule_seq, negated)`` for each rule that matches a path.

    Each path meets the rules of its ancestor directories by equality on the directory;
    no path is paired with rules from elsewhere. The root's rules concern every path, so
    a join too big to broadcast spreads each directory over ``copies`` tasks.
    """
    bases = F.concat(F.array(F.lit("")), ancestors(F.col("path")))
    candidates = paths.select("path", "is_dir", F.explode(bases).alias("base_path"))
    joined = spread_join(candidates, rules, ["base_path"], copies=copies)
    below = F.when(F.col("base_path") == "", F.col("path")).otherwise(
        F.substring(F.col("path"), F.length("base_path") + 2, F.length("path"))
    )
    candidate = F.when(F.col("path_pattern"), below).otherwise(F.substring_index("path", "/", -1))
    hit = (F.col("is_dir") | ~F.col("dir_only")) & F.call_function("rlike", candidate, F.col("regex"))
    return joined.filter(hit).select("path", "is_dir", "base_path", "rule_seq", "negated")


def last_match_wins(matches: DataFrame) -> DataFrame:
    """``(path, is_dir, ignored)`` from :func:`ignore_rule_join`: deeper base, then later line."""
    rank = F.struct(_depth(F.col("base_path")), F.col("rule_seq"))
    return matches.groupBy("path", "is_dir").agg(F.max_by(~F.col("negated"), rank).alias("ignored"))


def ignored_paths(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """Paths the rules drop by themselves, without regard to their ancestors."""
    return last_match_wins(ignore_rule_join(paths, rules)).filter("ignored").select("path", "is_dir")


def prune_subtree(entries: DataFrame, dropped_dirs: DataFrame) -> DataFrame:
    """Entries below none of ``dropped_dirs (path)``, even where a deeper rule would re-include them.

    Directories are judged once each, on their own, far smaller table; the entries then
    only look up their parent, which may be one directory holding most of them.
    """
    parents = entries.select(parent_dir(F.col("path")).alias("parent")).filter("parent <> ''").distinct()
    chains = parents.select(
        "parent", F.explode(F.concat(ancestors(F.col("parent")), F.array("parent"))).alias("path")
    )
    dead = chains.join(dropped_dirs.select("path"), "path", "left_semi").select("parent").distinct()
    live = spread_join(entries.withColumn("parent", parent_dir(F.col("path"))), dead, ["parent"], "left_anti")
    own = dropped_dirs.select("path", F.lit(True).alias("is_dir"))
    return live.join(own, ["path", "is_dir"], "left_anti").select(*entries.columns)


def _apply_by_join(entries: DataFrame, rules: DataFrame) -> DataFrame:
    above = entries.select(F.explode(ancestors(F.col("path"))).alias("path"), F.lit(True).alias("is_dir")).distinct()
    paths = entries.select("path", "is_dir").unionByName(above).distinct()
    dropped = ignored_paths(paths, rules)
    kept = prune_subtree(entries, dropped.filter("is_dir").select("path"))
    return kept.join(dropped.filter("NOT is_dir"), ["path", "is_dir"], "left_anti").select(*entries.columns)
