import re

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from assay.functions.globs import glob_to_regex, parse_rule_line
from assay.operators import ignore
from assay.schemas import RULE


def rules_of(files):
    """RULE rows of ``{base: [line, ...]}``."""
    rows = []
    for base, lines in files.items():
        for no, line in enumerate(lines, start=1):
            rule = parse_rule_line(line, no == 1)
            if rule:
                rows.append((base, no, rule["negated"], rule["dir_only"], rule["path_pattern"], rule["regex"]))
    return rows


def survivors(spark, files, paths, compiled=ignore.COMPILED_RULES):
    entries = spark.createDataFrame([(p.rstrip("/"), p.endswith("/")) for p in paths], "path string, is_dir boolean")
    rules = spark.createDataFrame(rules_of(files), RULE)
    kept = ignore.apply_ignore_rules(entries, rules, compiled_rules=compiled).collect()
    return {row.path + ("/" if row.is_dir else "") for row in kept}


CASES = [
    ({"": ["bin/"]}, ["bin/", "bin/x", "a/bin/", "a/bin/y", "c/bin"], {"c/bin"}),
    ({"": ["*.o", "!keep.o"]}, ["a.o", "d/b.o", "keep.o", "d/keep.o"], {"keep.o", "d/keep.o"}),
    ({"": ["/top.txt"]}, ["top.txt", "d/top.txt"], {"d/top.txt"}),
    ({"": ["out/*", "!/out/keep/"]}, ["out/a", "out/keep/", "out/keep/b"], {"out/keep/", "out/keep/b"}),
    # A dropped directory hides what a deeper rule would bring back.
    ({"": ["out/", "!out/keep"]}, ["out/keep"], set()),
    ({"": ["*.tmp"], "m": ["!mine.tmp", "own/"]}, ["m/x.tmp", "m/mine.tmp", "m/own/", "own/"], {"m/mine.tmp", "own/"}),
    ({"": ["a/**/z?.bin"]}, ["a/z1.bin", "a/b/c/z2.bin", "a/z.bin"], {"a/z.bin"}),
    ({"": ["lib[0-3]", "raw[!a]"]}, ["lib2", "lib9", "rawb", "rawa"], {"lib9", "rawa"}),
    ({"": ["# note", "\\#note", "\\!bang", "tail\\ ", "gone   "]}, ["#note", "!bang", "tail ", "gone", "tail"], {"tail"}),
    ({"": ["\ufefffirst", "second\r"]}, ["first", "second", "third"], {"third"}),
]


@pytest.mark.parametrize("compiled", [ignore.COMPILED_RULES, 0])
@pytest.mark.parametrize("files, paths, kept", CASES)
def test_rules(spark, files, paths, kept, compiled):
    assert survivors(spark, files, paths, compiled) == kept


@pytest.mark.parametrize(
    "line, parsed",
    [("", None), ("   ", None), ("#x", None), ("!", None), ("/", None), ("!/", None), ("a/", (False, True, False)), ("!a/b", (True, False, True))],
)
def test_rule_lines(line, parsed):
    rule = parse_rule_line(line, False)
    assert (rule and (rule["negated"], rule["dir_only"], rule["path_pattern"])) == parsed


@pytest.mark.parametrize(
    "glob, yes, no",
    [
        ("**", ["a/b"], []),
        ("a/**", ["a/b/c"], ["a", "b/a/c"]),
        ("**/a", ["a", "x/y/a"], ["xa"]),
        ("***", ["abc"], ["a/b"]),
        ("a\\*b", ["a*b"], ["axb"]),
        ("[", ["["], ["a"]),
        ("[]x]", ["]", "x"], ["a"]),
        ("[^x]", ["a"], ["x"]),
        ("a.b+c", ["a.b+c"], ["axbbc"]),
        ("tail\\", ["tail\\"], ["tail"]),
    ],
)
def test_globs(glob, yes, no):
    pattern = re.compile(glob_to_regex(glob))
    assert all(pattern.match(name) for name in yes)
    assert not any(pattern.match(name) for name in no)


def brute_force(files, paths):
    """The rules applied one path at a time, directories first."""
    rows = sorted(rules_of(files), key=lambda r: (len(r[0].split("/")) if r[0] else 0, r[1]))

    def ignored(path, is_dir):
        verdict = False
        for base, _, negated, dir_only, path_pattern, regex in rows:
            if (dir_only and not is_dir) or (base and not path.startswith(base + "/")):
                continue
            below = path[len(base) + 1 :] if base else path
            if re.match(regex, below if path_pattern else path.rpartition("/")[2]):
                verdict = not negated
        return verdict

    kept = set()
    for path in paths:
        parts = path.rstrip("/").split("/")
        above = any(ignored("/".join(parts[:n]), True) for n in range(1, len(parts)))
        if not above and not ignored(path.rstrip("/"), path.endswith("/")):
            kept.add(path)
    return kept


names = st.sampled_from(["a", "b", "ab", "a.o", "c"])
lines = st.sampled_from(["a", "!a", "*.o", "!*.o", "b/", "!b/", "/a/b", "a/*", "!a/b", "**/ab", "a/**", "[ab]", "!c", "?"])


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.dictionaries(st.sampled_from(["", "a", "b", "a/b"]), st.lists(lines, min_size=1, max_size=4), min_size=1),
    st.sets(st.lists(names, min_size=1, max_size=4).map("/".join).flatmap(lambda p: st.sampled_from([p, p + "/"])), min_size=1, max_size=25),
)
def test_both_ways_agree_with_brute_force(spark, files, paths):
    # A path is either a file or a directory.
    paths = {p for p in paths if not (p.endswith("/") and p[:-1] in paths)}
    expected = brute_force(files, paths)
    assert survivors(spark, files, paths) == expected
    assert survivors(spark, files, paths, compiled=0) == expected


def test_unreadable_rules_warn_and_contribute_nothing(spark, tmp_path):
    from assay.sources import filetree

    (tmp_path / "good").mkdir()
    (tmp_path / "good" / ".gitignore").write_bytes(b"x\n")
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / ".gitignore").write_bytes(b"y\n\xff\xfe\n")
    rules, warnings = filetree.read_ignore_rules(filetree.scan_without_root(spark, str(tmp_path)))
    assert [row.base_path for row in rules.collect()] == ["good"]
    assert [row.base_path for row in warnings.collect()] == ["bad"]


def test_a_join_too_big_to_broadcast_spreads_the_root_rules(spark, monkeypatch):
    from assay.plans import skew

    monkeypatch.setattr(skew, "BROADCAST_LIMIT_BYTES", -1)
    files = {"": ["*.o", "!keep.o", "out/"], "m": ["!m.o"]}
    paths = [f"d{n % 5}/f{n}.{'o' if n % 2 else 'c'}" for n in range(200)] + ["keep.o", "out/", "out/x", "m/m.o"]
    assert survivors(spark, files, paths, compiled=0) == brute_force(files, paths)
