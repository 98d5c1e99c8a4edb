import pytest
from pyspark.sql import functions as F

from assay.functions import digests, errors, numbers, paths, text


@pytest.mark.parametrize(
    "digest, content, expected",
    [
        ("md5", b"", "d41d8cd98f00b204e9800998ecf8427e"),
        ("md5", b"hello world", "5eb63bbbe01eeed093cb22bb8f5acdc3"),
        ("xxh3_128", b"", "99aa06d3014798d86001c324468d497f"),
        ("xxh3_128", b"hello world", "df8d09e93f874900a99b8775cc15b6c7"),
        ("sha256", b"", "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"),
    ],
)
def test_known_digests(evaluate, digest, content, expected):
    assert evaluate(digests.DIGESTS[digest](F.col("c")), c=bytearray(content)) == expected


def test_digest_exact_len_ignores_the_tail_and_reports_a_short_read(evaluate):
    whole = evaluate(digests.digest_exact_len(F.col("c"), F.lit(3)), c=bytearray(b"abcdef"))
    assert (whole.digest, whole.error) == ("900150983cd24fb0d6963f7d28e17f72", None)
    short = evaluate(digests.digest_exact_len(F.col("c"), F.lit(5)), c=bytearray(b"abc"))
    assert (short.digest, short.error) == (None, "2 bytes missing")


@pytest.mark.parametrize("value, ok", [("a" * 32, True), ("A" * 32, True), ("a" * 31, False), ("+" + "a" * 31, False), ("a" * 32 + "\n", False)])
def test_valid_digest(evaluate, value, ok):
    assert evaluate(digests.valid_digest(F.col("v")), v=value) is ok


@pytest.mark.parametrize(
    "size, truncated, rounded",
    [
        (0, "0 B", "0 B"),
        (1023, "1023 B", "1023 B"),
        (1024, "1.0 KB", "1.0 KB"),
        (1996, "1.9 KB", "1.9 KB"),
        (2047, "1.9 KB", "2.0 KB"),
        (1024**2, "1.0 MB", "1.0 MB"),
        (5 * 1024**4 + 1024**4 // 2, "5.5 TB", "5.5 TB"),
        (2048 * 1024**4, "2048.0 TB", "2048.0 TB"),
    ],
)
def test_sizes(evaluate, size, truncated, rounded):
    assert evaluate(text.format_bytes(F.lit(size).cast("bigint"))) == truncated
    assert evaluate(text.format_bytes_rounded(F.lit(size).cast("bigint"))) == rounded


def test_waits_double_up_to_a_ceiling(evaluate):
    waits = [evaluate(numbers.backoff_seconds(F.lit(n))) for n in range(1, 9)]
    assert waits == [1, 2, 4, 8, 16, 32, 32, 32]
    assert [evaluate(numbers.cumulative_backoff(F.lit(n))) for n in range(1, 9)] == [sum(waits[:n]) for n in range(1, 9)]


def test_saturating(evaluate):
    top = 2**63 - 1
    assert evaluate(numbers.saturating_add(F.lit(top), F.lit(1))) == top
    assert evaluate(numbers.saturating_add(F.lit(2), F.lit(3))) == 5
    assert evaluate(numbers.doubled_work(F.lit(top // 2 + 1))) == top


def test_progress_ratios(evaluate):
    assert evaluate(numbers.progress_fraction(F.lit(5), F.lit(0))) == 0.0
    assert evaluate(numbers.progress_fraction(F.lit(7), F.lit(4))) == 1.0
    assert evaluate(numbers.progress_permille(F.lit(1), F.lit(3))) == 333
    assert evaluate(numbers.progress_permille(F.lit(2**62), F.lit(2**63 - 1))) == 500
    assert evaluate(numbers.progress_permille(F.lit(3), F.lit(0))) == 0


@pytest.mark.parametrize(
    "path, key",
    [("a//b", "a/b"), ("a/./b", "a/b"), ("a/b/", "a/b"), ("./a", "./a"), ("/a//b", "/a/b"), ("", "")],
)
def test_normalize_path_key(evaluate, path, key):
    assert evaluate(paths.normalize_path_key(F.col("p")), p=path) == key


@pytest.mark.parametrize(
    "path, unsafe",
    [("a/b", False), ("a/..b", False), ("../a", True), ("a/../b", True), ("a\\..\\b", True), ("/a", True), ("C:a", True), ("..", True)],
)
def test_unsafe_paths(evaluate, path, unsafe):
    assert evaluate(paths.is_unsafe_path(F.col("p")), p=path) is unsafe


@pytest.mark.parametrize(
    "parts, is_dir, basic, extended",
    [
        (["__pycache__"], True, True, True),
        (["x", ".ruff_cache"], True, True, True),
        (["cache"], True, False, False),
        ([".work-venv"], True, True, True),
        (["lib.egg-info"], True, True, True),
        (["app.onefile-build"], True, False, False),
        (["app.BUILD"], True, True, True),
        (["dist"], False, False, False),
        ([".gradle"], True, False, True),
        (["src-tauri", "gen"], True, False, True),
        (["gen"], True, False, False),
        (["cmake-build-release"], True, False, True),
        (["Thumbs.DB"], False, True, True),
        (["m.pyo"], False, False, True),
        (["._photo.jpg"], False, False, True),
        ([".git"], True, False, False),
    ],
)
def test_junk(evaluate, parts, is_dir, basic, extended):
    column = F.array(*[F.lit(part) for part in parts])
    assert evaluate(paths.is_junk_basic(column, F.lit(is_dir))) is basic
    assert evaluate(paths.is_junk_extended(column, F.lit(is_dir))) is extended


@pytest.mark.parametrize(
    "source, destination, refused",
    [
        ("/a/b", "/a/b/c", True),
        ("/a/b", "/a/b", True),
        ("/a/b", "/a/b2", False),
        ("/a/b", "/a", True),
        ("/a/b", "/a/", True),
        ("/a/b", "/c", False),
    ],
)
def test_overlap(evaluate, source, destination, refused):
    assert evaluate(paths.overlaps(F.lit(source), F.lit(destination))) is refused


def test_base64url_round_trip(evaluate):
    code = evaluate(text.base64url_encode(F.lit("~~??é" * 60)))
    assert "+" not in code and "/" not in code and "\n" not in code and "\r" not in code
    assert evaluate(text.base64url_decode(F.lit(code))) == "~~??é" * 60
    assert evaluate(text.base64url_decode(F.lit("*"))) is None


def test_json_report_escapes(evaluate):
    import json

    raw = 'q"b\\n\nr\rt\t'
    report = evaluate(text.json_report(F.lit("a/b"), F.lit(2), F.lit(10), F.lit(raw)))
    assert json.loads(report) == {"source_relative": "a/b", "attempts": 2, "unix_time": 10, "reason": raw}


def test_nfc(evaluate):
    assert evaluate(text.nfc(F.lit("e\u0301"))) == "é"
    assert evaluate(text.nfc(F.lit("soft\u00adhyphen"))) == "soft\u00adhyphen"


@pytest.mark.parametrize(
    "kind, io, cls",
    [
        ("SanityFailed", None, "DEVICE"),
        ("RetriesExhausted", None, "FILE"),
        ("SourceRead", "StorageFull", "FILE"),
        ("HashMismatch", None, "TRANSIENT"),
        ("Io", "NotFound", "DEVICE"),
        ("VerifyRead", "TimedOut", "TRANSIENT"),
    ],
)
def test_classes(evaluate, kind, io, cls):
    assert evaluate(errors.classify_error(F.lit(kind), F.lit(io))) == cls


def test_attempt_outcome(evaluate):
    def outcome(cls, attempt, unlimited=False):
        return evaluate(errors.attempt_outcome(F.lit(cls), F.lit(attempt), 3, unlimited))

    assert [outcome("TRANSIENT", n) for n in (1, 2, 3)] == ["retry", "retry", "give_up"]
    assert outcome("TRANSIENT", 50, unlimited=True) == "retry"
    assert outcome("FILE", 3, unlimited=True) == "give_up"
    assert outcome("DEVICE", 1, unlimited=True) == "stop"


def test_nfc_holds_few_texts_at_a_time(monkeypatch):
    import pyarrow as pa

    from assay.functions import text

    monkeypatch.setattr(text, "BYTES_AT_ONCE", 8)
    texts = ["café", None, "", "plain", "한", "̈́" * 9]
    seen, plain = [], text.unicodedata.normalize
    assert text.normalized(pa.array(texts)).to_pylist() == [t and plain("NFC", t) for t in texts]
    assert text.normalized(pa.array([None, None], pa.string())).to_pylist() == [None, None]
    pieces = text.pa.concat_arrays
    monkeypatch.setattr(text.pa, "concat_arrays", lambda arrays: seen.extend(map(len, arrays)) or pieces(arrays))
    text.normalized(pa.array(texts))
    assert seen == [3, 1, 1, 1]
