"""Large quoted files read in splits equal the unsplit read; headers that differ; dense row numbers."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from chronoframe.operators.derive import derive_session_log
from chronoframe.operators.numbering import dense_row_number
from chronoframe.operators.scan import _untimed_chunk
from chronoframe.sources import csv_sessions
from chronoframe.sources.csv_sessions import read_kind, read_session_dir, read_session_files
from chronoframe.sources.csv_splits import INSIDE, OUTSIDE, Grammar, line_start, records

CELLS = ['', 'NULL', 'plain', 'a;b', 'say ""x""', 'two\nlines', 'win\r\nlines', '\n\n', '""', 'é日', 'tail "quote', '\\', ' x ', '";\n"']


def _random_file(rng, n, end="\n"):
    """Cells quoted at random, stray quotes inside unquoted ones, ragged and blank lines, very long cells."""
    lines = ["i;a;b;c"]
    for i in range(n):
        cells = [str(i)]
        for _ in range(rng.choice([3, 3, 3, 3, 1, 5])):
            c = rng.choice(CELLS) * rng.choice([1, 1, 1, 40])
            plain = not any(x in c for x in ';\n\r') and not c.startswith('"')
            cells.append(c if plain and rng.random() < 0.5 else '"' + c.replace('"', '""') + '"' + rng.choice(["", "", "z"]))
        lines.append(";".join(cells))
        if rng.random() < 0.05:
            lines.append("")
    return end.join(lines) + rng.choice(["", end])


def _plain(text):
    rows = [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=";") if r][1:]
    clean = lambda v: None if v == "NULL" else v
    return [tuple(clean(v) for v in (r + [""] * 4)[:4]) for r in rows]


@pytest.mark.parametrize("seed", [1, 2])
def test_split_read_equals_unsplit(spark, tmp_path, seed):
    rng = random.Random(seed)
    want = []
    for k, end in enumerate(["\n", "\r\n"]):
        text = _random_file(rng, 120, end)
        want += _plain(text)
        with open(tmp_path / f"s{k}_Sample.csv", "w", newline="", encoding="utf-8") as f:
            f.write(text)
    for split in (211, 1 << 20):
        rows = read_kind(spark, str(tmp_path), "Sample", split_bytes=split).collect()
        rows.sort(key=lambda r: r["_ord"])
        assert [tuple(r)[:4] for r in rows] == want
        assert len({r["_ord"] for r in rows}) == len(rows)


def test_one_large_file_goes_to_many_tasks(spark, tmp_path):
    row = '2022-01-01 10:00:00;"a ""note""\nwith; breaks %d";x\n'
    with open(tmp_path / "big_Sample.csv", "w") as f:
        f.write("Timestamp;Note;E\n")
        f.writelines(row % i for i in range(60_000))
    df = read_kind(spark, str(tmp_path), "Sample", split_bytes=256 << 10)
    used = df.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(used) >= 4 and sum(r["count"] for r in used) == 60_000
    assert max(r["count"] for r in used) < 60_000 / 2
    notes = df.orderBy("_ord").select("Note").collect()
    assert [r["Note"] for r in notes[::997]] == [f'a "note"\nwith; breaks {i}' for i in range(0, 60_000, 997)]


def test_small_splits_share_tasks_and_read_little(spark, tmp_path):
    with open(tmp_path / "small_Sample.csv", "w") as f:
        f.write("i;Note\n")
        f.writelines(f'{i};"a\nb {i}"\n' for i in range(4_000))
    df = read_kind(spark, str(tmp_path), "Sample", split_bytes=100)
    assert df.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism
    assert [r["Note"] for r in df.orderBy("_ord").collect()] == [f"a\nb {i}" for i in range(4_000)]


class _Counted(io.BytesIO):
    taken = 0

    def read(self, n=-1):
        data = super().read(n)
        self.taken += len(data)
        return data


def test_line_ends_are_found_with_short_reads():
    data = b'1;"x\ny"\n' * 400_000
    file = _Counted(data)
    begin, end = (line_start(file, at, len(data)) for at in (1_000_000, 1_001_000))
    assert data[begin - 1 : begin] == b"\n" and records(file, begin, end, len(data), OUTSIDE, Grammar(";"))
    assert file.taken < 30_000
    long = _Counted(b'1;"' + b"x\n" * 2_000_000 + b'"\n2;y\n')  # a record over many reads
    size = len(long.getvalue())
    assert records(long, 0, 5, size, OUTSIDE, Grammar(";")) == long.getvalue()[:-4]


def test_states_of_a_split():
    g = Grammar(";")
    assert g.state_after(b'a;"b\n', OUTSIDE) == INSIDE and g.state_after(b'a;"b\n', INSIDE) == OUTSIDE
    assert g.state_after(b'a;b"c\n', OUTSIDE) == OUTSIDE  # a quote inside an unquoted cell is a character
    assert g.state_after(b'x""y\n', INSIDE) == INSIDE
    assert g.state_after(b'x";"y\n', INSIDE) == INSIDE
    assert g.state_after(b"no quotes\n", INSIDE) == INSIDE


def test_three_headers_need_no_join(spark, tmp_path):
    heads = ["A;B;C", "C;A", "B;X;A;C"]
    for i in range(9):
        names = heads[i % 3].split(";")
        with open(tmp_path / f"f{i}_Event.csv", "w") as f:
            f.write(";".join(names) + "\n" + ";".join(f"{c}{i}" for c in names) + "\n")
    df = read_kind(spark, str(tmp_path), "Event")
    rows = df.orderBy("_ord").collect()
    for i, r in enumerate(rows):
        names = heads[i % 3].split(";")
        assert {c: r[c] for c in "ABCX"} == {c: f"{c}{i}" if c in names else None for c in "ABCX"}
    above = df._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]
    assert "Exchange" not in above and "Join" not in above


def test_fallback_reader_gives_the_same_rows(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    for k, head in enumerate(["A;B", "B;A;C"]):
        with open(tmp_path / f"f{k}_Event.csv", "w") as f:
            f.write(head + "\n" + "".join(f'v{i};"w\n{i}";u\n'[: None if k else -2].rstrip("\n").rstrip(";") + "\n" for i in range(rng.randint(5, 9))))
    fast = read_kind(spark, str(tmp_path), "Event").orderBy("_ord").drop("_ord").collect()
    first_lines = csv_sessions._first_lines
    monkeypatch.setattr(csv_sessions, "_first_lines", lambda *a: (first_lines(*a)[0], False))
    slow = read_kind(spark, str(tmp_path), "Event").orderBy("_ord").drop("_ord").collect()
    assert slow == fast and len(fast) >= 10


def test_rows_without_a_time_are_split(spark, tmp_path):
    """Half of the times of a CSV log are missing: those rows spread over chunks, values as with one window."""
    with open(tmp_path / "s_Sample.csv", "w") as f:
        f.write("Timestamp;Event;SessionID;Participant;i1\n")
        f.writelines(
            f"{'2022-01-01 10:%02d:00' % (i // 500 % 60) if i % 2 else 'NULL'};{'Game Started' if i == 0 else 'Sample'};S;1;C\n"
            for i in range(20_000)
        )
    raw = read_session_dir(spark, str(tmp_path), event=None, meta=None, split_bytes=100_000)
    sizes = raw.where("Timestamp is null").groupBy(_untimed_chunk(raw, ["_ord"])).count().collect()
    assert len(sizes) > 4 and max(r["count"] for r in sizes) < 4_000
    raw = raw.select("Timestamp", "Event", "Participant", F.lit("C").alias("Condition"), "_ord")
    keys = ["Participant", "Condition"]
    one = derive_session_log(raw, keys, grains=()).select("_ord", "PlayPeriod", "Time_delta")
    assert derive_session_log(raw, keys).select(*one.columns).exceptAll(one).isEmpty()


def test_explicit_files(spark, tmp_path):
    for kind, lines in {"Meta": "SessionID;ParticipantID\nS;7", "Event": "SessionID;Event\nS;e1\nS;e2", "Sample": "Event;SessionID\ns1;S"}.items():
        with open(tmp_path / f"x_{kind}.csv", "w") as f:
            f.write(lines + "\n")
    paths = [str(tmp_path / f"x_{k}.csv") for k in ("Meta", "Event", "Sample")]
    rows = read_session_files(spark, *paths).orderBy("_ord").collect()
    assert [(r["Event"], r["ParticipantID"]) for r in rows] == [("e1", "7"), ("e2", "7"), ("s1", "7")]


def test_dense_row_number(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, *range(50)]), i) for i in range(3_000)]
    df = spark.createDataFrame(rows, "a int, b long").repartition(6)
    got = sorted((r["row_number"], r["a"], r["b"]) for r in dense_row_number(df, ["a", F.col("b").desc()], partitions=7).collect())
    want = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, -r[1]))
    assert got == [(i + 1, *r) for i, r in enumerate(want)]
    assert dense_row_number(df.limit(0), ["a"]).count() == 0
