import io
import os
import zipfile

import duckdb
import pytest

from quirepack.functions.names import archive_name, mask_regex
from quirepack.operators.encode import CODECS, encode_one
from quirepack.operators.zip_file import ArchiveError
from quirepack.plans import archive, policy, queries
from quirepack.sources.files import InputError

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    got = queries.QUERIES[name](spark, DATA)
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
        want = db.sql(queries.oracle_sql()[name])
        columns = sorted(got.columns)
        assert sorted(want.columns) == columns
        rows = lambda table: sorted(map(repr, table))
        assert rows(map(tuple, got.select(*columns).collect())) == rows(want.select(", ".join(f'"{c}"' for c in columns)).fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.oracle_sql())))
def test_query_gives_a_row_per_document(spark, name):
    assert queries.QUERIES[name](spark, DATA).count() == 200


def test_members_inflate_to_their_payload(spark):
    assert queries.archive_roundtrip(spark, DATA).where("not same").count() == 0


@pytest.mark.parametrize(("mask", "name", "match"), [("*", "a", True), ("*", ".a", False), ("[.]x", ".x", False), ("[!a]x", "bx", True), ("[!a]x", ".x", False), ("[[:digit:]]*", "7z", True), ("a\\*", "a*", True), ("a\\*", "ab", False), ("*?", "ab", True), ("*?", ".b", False), ("d/*.t", "d/a.t", True), ("d/*.t", "d/.a.t", False), ("d/*", "d/e/f", False), ("a[", "a[", True)])
def test_masks(mask, name, match):
    import re

    assert bool(re.fullmatch(mask_regex(mask), name)) is match


def test_archive_names():
    assert [archive_name(x) for x in ("a", "a.", "a.zip", ".a", "d.x/a", "a.7z")] == ["a.zip", "a.zip", "a.zip", ".a.zip", "d.x/a.zip", "a.7z"]
    with pytest.raises(ValueError):
        archive_name("d/")


def test_sizes_and_options():
    assert [policy.parse_size(x) for x in ("off", "0", "8192B", "1KiB", "2MiB")] == [None, 0, 8192, 1024, 2 << 20]
    for bad in ("1*1024", "KiB", "-1", "1kib"):
        with pytest.raises(policy.PolicyError):
            policy.parse_size(bad)
    got = policy.parse_arguments(["-9", "a", "--zlib_level", "3", "x", "--", "@y", "-z"])
    assert (got.level, got.archive, got.inputs, got.policy.zlib_level, got.literal_from) == (9, "a", ["x", "@y", "-z"], 3, 1)
    assert "--zopfli_greed" in policy.parse_arguments(["--full-help"])
    for bad in (["a", "--nope"], ["a", "--zlib_level", "10"], ["a", "--zlib_level"], ["-9"]):
        with pytest.raises(policy.PolicyError):
            policy.parse_arguments(bad)


def test_ini_sections():
    text = policy.default_ini()
    for level in range(1, 10):
        assert policy.read_section(text, level, policy.preset(level)) == policy.preset(level)
    own = policy.read_section("[1]\nnonsense\n[2]\n-r\n# c\n--zopfli_greed 9\n", 2, policy.preset(2))
    assert own.recursive and own.engines == {"ect"} and dict(own.ect)["greed"] == 9
    for bad in ("[2]\n[2]\n", "[2]\nstray\n", "[3]\n"):
        with pytest.raises(policy.PolicyError):
            policy.read_section(bad, 2, policy.preset(2))


def test_choice_of_encoder():
    own = archive.policy_dict(policy.preset(9)) | {"engines": ["fast", "ect", "turtle"]}
    same = {k: lambda data, p: b"x" for k in CODECS}
    assert encode_one(b"12345", own, same)[1] == "turtle"
    assert encode_one(b"12345", own, same | {"turtle": lambda data, p: None})[1] == "fast"
    assert encode_one(b"1", own, same)[1:] == (None, 0, b"1")
    assert encode_one(b"1", own | {"zlib_after": 0}, same)[1:3] == ("zlib", 8)
    assert encode_one(b"", own)[2:] == (8, b"\x03\x00")
    assert encode_one(b"12345", own, {k: lambda data, p: None for k in CODECS})[1:3] == (None, 0)


@pytest.fixture
def tree(tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    for name, data in {"top.txt": b"one " * 1000, ".hidden": b"h", "nested/deep.txt": b"two", "nested/.x/y.md": b"m", "empty": b"", "noise": os.urandom(4096)}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    (tmp_path / "link").symlink_to("top.txt")
    return tmp_path


def test_archives(spark, tree):
    path, n = archive.run(spark, ["-6", "out", "top.txt", "empty", "noise"])
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None and z.namelist() == ["top.txt", "empty", "noise"] and n == 3
        assert [i.compress_type for i in z.infolist()] == [8, 8, 0]
        assert [i.flag_bits & 6 for i in z.infolist()] == [4, 4, 0]
        packed = sum(i.compress_size for i in z.infolist())
        assert os.path.getsize(path) == 22 + packed + sum(76 + 2 * len(i.filename) for i in z.infolist())
    archive.run(spark, ["out"])
    with zipfile.ZipFile("out.zip") as z:
        assert z.namelist() == ["empty", "noise", "top.txt"]
    archive.run(spark, ["-r", "all", ".", "@*.txt", "@*.md"])
    with zipfile.ZipFile("all.zip") as z:
        assert sorted(z.namelist()) == ["nested/.x/y.md", "nested/deep.txt", "top.txt"]
    archive.run(spark, ["l", "link"])
    with zipfile.ZipFile("l.zip") as z:
        assert z.read("link") == b"one " * 1000
    for bad in (["o", "top.txt", "./top.txt"], ["o", "nested"], ["out", "out.zip"], ["o", "-r", "nested", "@*.zz"], ["o", "../x"]):
        with pytest.raises((InputError, OSError)):
            archive.run(spark, bad)


def test_a_corrupt_archive_is_not_published(spark, tree):
    from quirepack.operators.zip_file import write_archive

    (tree / "old.zip").write_bytes(b"old")
    os.chmod(tree / "old.zip", 0o640)
    ready = archive.text_members(spark.createDataFrame([(1, "text " * 300, "en", "s"), (2, None, "en", "s")], "doc_id long, text string, lang string, source string"), policy.preset(6), 6)

    def flip(path):
        with open(path, "r+b") as f:
            f.seek(50)
            f.write(bytes([f.read(1)[0] ^ 0x80]))

    with pytest.raises(ArchiveError):
        write_archive(ready, "old.zip", flip)
    assert (tree / "old.zip").read_bytes() == b"old" and not [x for x in os.listdir() if ".tmp." in x]
    assert write_archive(ready, "old.zip") == 2
    assert os.stat("old.zip").st_mode & 0o777 == 0o640
    with zipfile.ZipFile(io.BytesIO((tree / "old.zip").read_bytes())) as z:
        assert z.testzip() is None and z.read("s/en/2.txt") == b""


def test_encoders_that_saw_other_bytes_fail_the_run(spark):
    from quirepack.operators.encode import race

    rows = spark.createDataFrame([(1, "a", b"text " * 50), (2, "b", None)], "ordinal long, name string, payload binary")
    own = archive.policy_dict(policy.preset(9)) | {"engines": ["fast", "turtle"]}
    lying = dict(CODECS) | {"turtle": lambda data, p: CODECS["fast"](data[:-1], p)}
    shown = race(rows, own, lying, strict=False).where("ordinal = 1").first()["candidates"]
    assert len({c["crc"] for c in shown}) == 2
    with pytest.raises(Exception, match="different bytes"):
        race(rows, own, lying).collect()
    assert race(rows, own).count() == 2


def test_a_changed_stored_copy_fails_the_run(spark):
    from quirepack.operators.entries import stored_copies

    rows = spark.createDataFrame([("a", 0, 907060870, b"hello"), ("b", 8, 1, b"x")], "name string, method int, crc long, data binary")
    assert stored_copies(rows).count() == 2
    with pytest.raises(Exception, match="input changed: a"):
        stored_copies(rows.withColumn("crc", rows.crc + 1)).collect()


def test_inputs_are_read_in_chunks(spark, tree):
    from quirepack.sources.files import chunks

    assert [len(x) for x in chunks(io.BytesIO(b"x" * 25), 25, "f", 10)] == [10, 10, 5] and not list(chunks(io.BytesIO(b""), 0, "f"))
    for size in (24, 26):
        with pytest.raises(InputError):
            list(chunks(io.BytesIO(b"x" * 25), size, "f", 10))
    (tree / "long").write_bytes(os.urandom(1 << 20) * 3 + b"end")
    archive.run(spark, ["-6", "z", "top.txt", "long", "empty", "--zlib_after", "1MiB"])
    with zipfile.ZipFile("z.zip") as z:
        assert z.testzip() is None and z.read("long") == (tree / "long").read_bytes()
        assert [i.compress_type for i in z.infolist()] == [8, 8, 8]


def test_progress_is_aligned_and_ends_at_100(spark, tree):
    (tree / "日本.txt").write_bytes(b"w" * 50)
    out = io.StringIO()
    archive.run(spark, ["p", "top.txt", "日本.txt", "empty"], show=out)
    assert out.getvalue().splitlines() == ["top.txt    98.74%", "日本.txt   99.97%", "empty     100.00%"]


def test_a_signal_removes_the_temporary_file(tmp_path):
    import signal

    from quirepack.operators.zip_file import removed_on_signal

    before = signal.getsignal(signal.SIGTERM)
    path = tmp_path / "a.zip.tmp.1"
    path.write_bytes(b"half")
    with pytest.raises(SystemExit) as left, removed_on_signal(str(path)):
        os.kill(os.getpid(), signal.SIGTERM)
        signal.pause()
    assert left.value.code == 128 + signal.SIGTERM and not path.exists() and signal.getsignal(signal.SIGTERM) is before


def test_a_default_ini_is_created_once(tmp_path):
    path = str(tmp_path / "quirepack.ini")
    assert policy.load(9, created=path) == policy.preset(9) and os.path.exists(path)
    with open(path, "w") as f:
        f.write("[2]\n--zopfli_greed 9\n")
    assert policy.load(2, created=path).engines == {"ect"}
    assert policy.load(2, search=(path,), created=str(tmp_path / "other.ini")).engines == {"ect"} and not (tmp_path / "other.ini").exists()
    with pytest.warns(UserWarning, match="compiled settings"):
        assert policy.load(3, created=str(tmp_path / "none" / "x.ini")) == policy.preset(3)


def test_invalid_utf8_names_have_no_flag(spark):
    from quirepack.functions.names import name_flags

    rows = spark.createDataFrame([(b"ok\xc3\xa9",), (b"\xc0\xaf",), (b"\xed\xa0\x80",), (b"\xff",)], "raw binary")
    assert [r[0] for r in rows.select(name_flags(rows.raw)).collect()] == [0x0800, 0, 0, 0]


def test_ordinals_far_apart_fill_no_single_range(spark):
    from quirepack.operators.entries import member_offsets, progress

    rows = spark.createDataFrame([(i if i < 99 else 1 << 60, 3, 2**32 - 1, 10) for i in range(100)], "ordinal long, name_len int, size long, compressed long")
    got = [r["local_offset"] for r in member_offsets(rows).orderBy("ordinal").collect()]
    assert got == [43 * i for i in range(100)]
    assert [r["percent_hundredths"] for r in progress(rows).orderBy("ordinal").collect()] == [100 * (i + 1) for i in range(100)]


def test_the_full_help_explains_every_setting():
    lines = policy.full_help().splitlines()
    for name in [f"--zopfli_{x[0]}" for x in policy.ECT_SETTINGS] + [f"--turtledeflate_{x[0]}" for x in policy.TURTLE_SETTINGS] + ["--libdeflate_level", "--zlib_after", "--zlib_level"]:
        (line,) = [x for x in lines if x.split() and x.split()[0] == name]
        assert len(line.partition("): ")[2]) > 10


def test_memory_and_workers(tmp_path):
    from quirepack.plans import resources

    for path, most, now in (("", "max", 5), ("a", 1000, 300), ("a/b", 900, 500)):
        (tmp_path / path).mkdir(exist_ok=True)
        (tmp_path / path / "memory.max").write_text(f"{most}\n")
        (tmp_path / path / "memory.current").write_text(f"{now}\n")
    (tmp_path / "cgroup").write_text("1:cpu:/x\n0::/a/b\n")
    assert resources.group_memory(str(tmp_path / "cgroup"), str(tmp_path)) == 400
    assert resources.group_memory(str(tmp_path / "none")) is None
    assert resources.memory_budget() > 0
    assert [resources.workers(8, t, b << 20) for t, b in ((3, 1000), (100, 128), (100, 1), (100, 10000))] == [3, 2, 1, 8]
    assert [resources.admitted(c, 10) for c in ([], [50], [4, 4, 4], [4, 50, 1])] == [0, 1, 2, 1]
