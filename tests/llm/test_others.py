"""Chats, archives, vectors, the pipeline and the registered queries."""

import hashlib
import itertools
import math
import random

import numpy as np
import pytest
from cases import documents, same
from sieveline.llm import ann, chat, queries, warc

SF = "/root/testdata/sf0.001"


def cheapest(roles):
    """The least cost over all labels and merges, by trying each."""
    best = None
    for labels in itertools.product((1, 2, 3), repeat=len(roles)):
        for merged in itertools.product((False, True), repeat=len(roles)):
            state, cost = chat.START, 0
            for role, label, merge in zip(roles, labels, merged):
                cost += chat.RELABEL * (role != label)
                if merge:
                    if state != label:
                        break
                    cost += chat.MERGE
                    continue
                for _ in range(4):
                    if label in chat.FOLLOWS[state]:
                        break
                    state = [r for r in chat.FOLLOWS[state] if r != chat.SYSTEM][0]
                    cost += chat.INSERT
                else:
                    break
                state = label
            else:
                while state != chat.ASSISTANT:
                    state = {chat.START: chat.USER, chat.SYSTEM: chat.USER, chat.USER: chat.ASSISTANT}[state]
                    cost += chat.INSERT
                best = cost if best is None else min(best, cost)
    return best


def test_repair_costs_least():
    table, ending, rng = chat.actions(), chat._ending(chat.INSERT), random.Random(1)
    for _ in range(150):
        roles = [rng.randrange(4) for _ in range(rng.randrange(1, 6))]
        after, _ = chat.forward(roles, [0, chat.NEVER, chat.NEVER, chat.NEVER], table)
        assert min(after[s] + ending[s][0] for s in range(4)) == cheapest(roles), roles


def legal(rows):
    roles = [r.role for r in rows if "merge" not in r.action]
    roles = roles[1:] if roles[:1] == ["system"] else roles
    return roles and len(roles) % 2 == 0 and all(r == ("user", "assistant")[i % 2] for i, r in enumerate(roles))


def test_chats_are_legal_and_whole(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(rng.choice([1, 2, 3, 9, None]), rng.choice([None, *range(30)]), rng.choice(["user", "assistant", "system", None, "GPT", " Human "]), rng.choice(["a", None, "", "b<|im_end|>c", "x" * 50]), 1) for _ in range(400)]
    rows += rows[:5]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, place int")
    out = chat.repaired_chats(df).collect()
    assert len([r for r in out if r.place == 0]) == len(rows)
    small = [(r.conv_id, r.seq, r.turn, r.place, r.role_before, r.role, r.action, r.rendered) for r in out]
    monkeypatch.setattr(chat, "PIECE_TURNS", 3)
    same(chat.repaired_chats(df.repartition(6)).collect(), small)
    one = sorted((r for r in out if r.conv_id == 2), key=lambda r: (r.seq, r.place))
    assert legal(one)
    text = "".join(r.rendered for r in one)
    assert text.count("<|im_start|>") == text.count("<|im_end|>") == sum("merge" not in r.action for r in one)
    assert chat.repaired_chats(df.limit(0)).collect() == []


@pytest.mark.parametrize("piece", [1024, 2])
def test_repaired_rows_against_all_ways(spark, piece, monkeypatch):
    """Of whole conversations: every turn once and in order, a legal sequence, the least cost, the rendered texts."""
    monkeypatch.setattr(chat, "PIECE_TURNS", piece)
    rng, rows = random.Random(12), []
    names = ["user", "assistant", "system", "Human", " GPT", None, "tool", ""]
    for conv in range(120):
        rows += [(conv, k, rng.choice(names), rng.choice(["hi", None, "", f"t{k} <|im_start|>"])) for k in range(rng.randrange(1, 6))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    out = {}
    for r in chat.repaired_chats(df).collect():
        out.setdefault(r.conv_id, []).append(r)
    assert sorted(out) == sorted({r[0] for r in rows})
    code = {"user": 2, "human": 2, "assistant": 3, "gpt": 3, "system": 1}
    for conv, got in out.items():
        got.sort(key=lambda r: (r.seq, r.place))
        turns = [r for r in rows if r[0] == conv]
        assert [(r.seq, r.turn, r.role_before) for r in got if r.place == 0] == [(k, k, t[2]) for k, t in enumerate(turns)]
        assert legal(got) and all((r.action == "insert") == (r.place != 0) for r in got)
        wrong = [r for r in got if r.place == 0 and code.get((r.role_before or "").strip().lower()) != {"system": 1, "user": 2, "assistant": 3}[r.role]]
        assert [r.seq for r in got if "relabel" in r.action] == [r.seq for r in wrong]
        cost = sum(chat.INSERT * (r.action == "insert") + chat.RELABEL * ("relabel" in r.action) + chat.MERGE * ("merge" in r.action) for r in got)
        assert cost == cheapest([code.get((t[2] or "").strip().lower(), 0) for t in turns])
        text = ""
        for k, r in enumerate(got):
            own = (turns[r.seq][3] or "").replace("<|im_", "<| im_") if r.place == 0 else ""
            text += "\n\n" + own if "merge" in r.action else ("<|im_end|>\n" if k else "") + f"<|im_start|>{r.role}\n" + own
        assert "".join(r.rendered for r in got) == text + "<|im_end|>\n"


def test_long_turns_are_cut_into_pieces(spark, monkeypatch):
    """Turns of a million characters, and pieces cut by their size, change nothing."""
    rows = [(1, k, ("user", "assistant", "user")[k % 3], ("x" if k else "é") * (1_000_000 if k == 4 else 3000)) for k in range(12)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = sorted(tuple(r) for r in chat.repaired_chats(df).collect())
    monkeypatch.setattr(chat, "PIECE_CHARS", 5000)
    assert sorted(tuple(r) for r in chat.repaired_chats(df).collect()) == whole
    assert sum(len(r[-1]) for r in whole) > 1_000_000


def test_chat_that_is_legal_stays(spark):
    df = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a")], "conv_id long, turn long, role string, text string")
    out = chat.repaired_chats(df).collect()
    assert {r.action for r in out} == {"keep"}
    assert "".join(r.rendered for r in sorted(out, key=lambda r: r.turn)) == "<|im_start|>system\ns<|im_end|>\n<|im_start|>user\nu<|im_end|>\n<|im_start|>assistant\na<|im_end|>\n"


def pages(spark):
    rows = [(i, f"http://x/{i}", "<p>" + "y" * (i % 90)) for i in range(300)] + [(3, "http://x/3", "<p>yyy")] * 4
    rows += [(None, None, None), (None, None, None), (5, None, "z"), (6, "u\r\nX: 1", "")]
    return spark.createDataFrame([(*r, 1, "a") for r in rows], "page_id long, url string, html string, idx int, record string"), rows


def test_archive_and_audit(spark):
    df, rows = pages(spark)
    stored = warc.archive(df, file_records=40)
    records = stored.orderBy("file", "idx").collect()
    assert len(records) == len(set(rows)) and sum(r.copies for r in records) == len(rows)
    at = {}
    for r in records:
        assert r.start == at.get(r.file, 0) and r.stop - r.start == len(r.record)
        at[r.file] = r.stop
    some = records[0].file
    own = [bytes(r.record) for r in records if r.file == some]
    assert [x[2:] for x in warc.split_records(b"".join(own))] == [(r, "whole") for r in own]
    assert [x[2:] for x in warc.split_records(b"".join(map(warc.gzip_record, own)))] == [(r, "whole") for r in own]
    replica = warc.rotted(stored, share=4)
    bad = {(r.file, r.idx): r.record for r in replica.collect()}
    for fanout in (2, 16):
        got = {(r.file, r.idx): (r.status, r.record_sha256, r.page_id, r.copies) for r in warc.audit(stored, replica, fanout).collect()}
        want = {(r.file, r.idx): ("missing" if bad[r.file, r.idx] is None else "intact" if bad[r.file, r.idx] == r.record else "corrupt", hashlib.sha256(r.record).hexdigest(), r.page_id, r.copies) for r in records}
        assert got == want and {"missing", "corrupt", "intact"} == {x[0] for x in want.values()}


def test_audit_of_equal_extra_and_empty(spark):
    df, _ = pages(spark)
    stored = warc.archive(df, file_records=80)
    less = stored.where("idx <> 2 OR file <> 0")
    assert {r.status for r in warc.audit(stored, stored).collect()} == {"intact"}
    a, b = warc.merkle_tree(stored, 4), warc.merkle_tree(less, 4)
    assert [(r.file, r.idx, r.status) for r in warc.damaged_leaves(a, b, 4).collect()] == [(0, 2, "missing")]
    assert [(r.file, r.idx, r.status) for r in warc.damaged_leaves(b, a, 4).collect()] == [(0, 2, "extra")]
    assert warc.page_audit(df.limit(0)).collect() == []
    assert warc.page_audit(df).count() == stored.count()
    # records that only the replica holds, also a whole file of them, are reported with its columns
    place = lambda r: (r.file, r.idx)
    whole = {place(r): r for r in warc.audit(stored, stored).collect()}
    for part, fanout in (("file < 3 AND (idx <> 2 OR file <> 0)", 4), ("file = 99", 16)):
        some = stored.where(part)
        kept = {place(r) for r in some.select("file", "idx").collect()}
        out = {place(r): r for r in warc.audit(some, stored, fanout).collect()}
        assert {p: r[:-1] for p, r in out.items()} == {p: r[:-1] for p, r in whole.items()}
        assert {p: r.status for p, r in out.items()} == {p: "intact" if p in kept else "extra" for p in whole}
        back = {place(r): r.status for r in warc.audit(stored, some, fanout).collect()}
        assert back == {p: "intact" if p in kept else "missing" for p in whole}


def test_long_pages_and_ties(spark):
    """Pages of a million characters, and pages that share an id and url, are records like others."""
    rows = [(1, "http://x", "é" * 1_000_000), (1, "http://x", "short"), (1, "http://x", "short"), (None, None, "z" * 500_000), (2, "", None)]
    out = warc.page_audit(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(out) == 4 and sorted(r.copies for r in out) == [1, 1, 1, 2] and max(r.stop - r.start for r in out) > 2_000_000


def test_audit_takes_any_columns(spark):
    """Names that the trees use themselves, nulls, and replicas with no other columns."""
    rows = [(f, i, 10 * i, 10 * i + 10, None if i == 3 else bytes([f, i]), "s", None, 1, "r", "d") for f in range(5) for i in range(7)]
    df = spark.createDataFrame(rows, "file long, idx long, start long, stop long, record binary, sha string, rest string, level int, span string, digest string")
    other = df.withColumn("record", warc.F.when(warc.F.col("file") == 2, warc.F.lit(b"x")).otherwise(warc.F.col("record")))
    out = warc.audit(df, other, 2).collect()
    assert len(out) == 35 and {r.status for r in out if r.file == 2} == {"corrupt"} == {r.status for r in out if r.status != "intact"}
    assert {(r.sha, r.rest, r.level, r.span, r.digest) for r in out} == {("s", None, 1, "r", "d")}
    bare = df.select("file", "idx", "start", "stop", "record")
    assert warc.audit(bare, bare.where("file < 4"), 2).groupBy("status").count().orderBy("status").collect() == [("intact", 28), ("missing", 7)]


def test_descent_reads_only_folders_that_differ(spark, monkeypatch):
    rows = [(f, i, 10 * i, 10 * i + 10, bytes([f, i])) for f in range(60) for i in range(4)]
    df = spark.createDataFrame(rows, "file long, idx long, start long, stop long, record binary")
    one = df.withColumn("record", warc.F.when(warc.F.expr("file = 17 AND idx = 2"), warc.F.lit(b"x")).otherwise(warc.F.col("record")))
    read, level = [], warc.Tree.level

    def seen(self, n, files=None):
        out = level(self, n, files)
        read.append((n, out.select("span").distinct().count(), level(self, n).select("span").distinct().count()))
        return out

    a, b = warc.merkle_tree(df, 4), warc.merkle_tree(one, 4)
    monkeypatch.setattr(warc.Tree, "level", seen)
    assert [(r.file, r.idx, r.status) for r in warc.damaged_leaves(a, b, 4).collect()] == [(17, 2, "corrupt")]
    assert [x[:2] for x in read if x[0] == 0] == [(0, 1)] * 2 and all(some <= 4 for n, some, _ in read) and max(x[2] for x in read) == 60
    plan = a.level(0, [range(17, 18)])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "17" in plan.split("PartitionFilters")[1][:80]


def test_read_warc(spark, tmp_path):
    df, _ = pages(spark)
    stored = warc.archive(df, file_records=400).orderBy("file", "idx").collect()
    (tmp_path / "a.warc").write_bytes(b"".join(bytes(r.record) for r in stored))
    (tmp_path / "b.warc").write_bytes(b"no record at all")
    (tmp_path / "c.warc").write_bytes(b"")
    got = warc.read_warc(spark, f"file://{tmp_path}").collect()
    assert sorted(bytes(r.record) for r in got if r.path.endswith("a.warc")) == sorted(bytes(r.record) for r in stored)
    assert [(bytes(r.record), r.state) for r in got if not r.path.endswith("a.warc")] == [(b"no record at all", "damaged")]


def record(i, body=b"some text "):
    body = body * (i % 40)
    return b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(body), body)


def test_damaged_and_cut_files():
    """Each damage is reported, and the records around it are found."""
    records = [record(i) for i in range(1, 9)]
    packed = [warc.gzip_record(r) for r in records]
    data, at = b"".join(packed), [sum(map(len, packed[:k])) for k in range(9)]
    for k in range(at[3], at[4]):
        hurt = data[:k] + bytes([data[k] ^ 0x55]) + data[k + 1 :]
        out = list(warc.split_records(hurt))
        assert [x[0] for x in out][0] == 0 and out[-1][1] == len(data) and all(x[1] == y[0] for x, y in zip(out, out[1:]))
        assert {x[2] for x in out if x[3] == "whole"} >= {r for i, r in enumerate(records) if i != 3}
    assert sum(x[3] == "damaged" for x in warc.split_records(data[: at[3] + 15] + b"\xff" * 8 + data[at[3] + 23 :])) == 1
    cut = list(warc.split_records(data[:-5]))
    assert [x[3] for x in cut] == ["whole"] * 7 + ["truncated"]
    plain = b"".join(records)
    assert [x[3] for x in warc.split_records(plain[:-5])] == ["whole"] * 7 + ["truncated"]
    wrong = plain.replace(b"Content-Length: 40\r", b"Content-Length: 41\r")
    assert [x[3] for x in warc.split_records(wrong)] == ["whole"] * 3 + ["damaged"] + ["whole"] * 4
    assert list(warc.split_records(b"")) == []


def test_many_records_take_time_in_proportion():
    import time

    packed = b"".join(warc.gzip_record(record(i)) for i in range(100))
    times = []
    for n in (100, 1000):
        began = time.perf_counter()
        assert sum(1 for _ in warc.split_records(packed * n)) == 100 * n
        times.append(time.perf_counter() - began)
    assert times[1] < 40 * times[0]


def test_stored_replicas_are_audited(spark, tmp_path):
    """Two folders of packed files, one with a flipped byte, a cut end and a file more."""
    files = {f"f{k}.warc.gz": [record(10 * k + i) for i in range(6)] for k in range(4)}
    for side in "ab":
        (tmp_path / side).mkdir()
        for name, some in files.items():
            data = b"".join(map(warc.gzip_record, some))
            if side == "b" and name == "f1.warc.gz":
                data = data[:-9]
            if side == "b" and name == "f2.warc.gz":
                k = sum(len(warc.gzip_record(r)) for r in some[:2]) + 20
                data = data[:k] + bytes([data[k] ^ 0xFF]) + data[k + 1 :]
            (tmp_path / side / name).write_bytes(data)
    (tmp_path / "b" / "g.warc").write_bytes(record(1))
    a, b = warc.numbered(*(warc.read_warc(spark, f"file://{tmp_path}/{side}") for side in "ab"))
    got = {(r.name, r.idx): r.status for r in warc.audit(a, b, 4).collect() if r.status != "intact"}
    assert got.pop(("g.warc", 0)) == "extra"
    assert got == {("f1.warc.gz", 5): "missing", ("f2.warc.gz", 2): "missing"}


def vectors(spark, n=400, d=16, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in rng.standard_normal(d)]) for i in range(n)]
    rows[3] = (3, rows[100][1])
    rows[7] = (7, rows[100][1])
    rows += [(1000, None), (1050, [0.0] * d), (1100, [math.nan] * d), (1150, [math.inf] + [1.0] * (d - 1)), (1200, [None] + [1.0] * (d - 1)), (1250, [1.0, 2.0]), (1300, []), (None, rows[1][1]), rows[5], rows[50]]
    return spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, rank int")


def brute(df, k, every):
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in df.collect() if r.vec_id is not None and r.embedding and None not in r.embedding and np.isfinite(r.embedding).all() and any(r.embedding)]
    out = []
    for q, v in dict((r[0], r[1]) for r in rows if r[0] % every == 0).items():
        near = sorted(((-(v @ x) / (np.linalg.norm(v) * np.linalg.norm(x)), i) for i, x in rows if i != q and len(x) == len(v)))[:k]
        out += [(q, n + 1, i, round(-s, 9)) for n, (s, i) in enumerate(near)]
    return out


def test_neighbours(spark):
    df = vectors(spark)
    got = [(r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in ann.exact_nearest(df, 5, 50).collect()]
    want = brute(df, 5, 50)
    rounded = lambda rows: [(q, n, s) for q, n, i, s in rows]  # noqa: E731  copies may change places by their last bit
    same(rounded(got), rounded(want))
    assert ann.recall(df, 5, 10) >= 0.95
    many = ann.nearest(df, 5, 50, block_rows=20, part_rows=3).collect()
    assert len(set((r.query_id, r.vec_id) for r in many) & set((q, i) for q, _, i, _ in want)) >= 0.95 * len(want)
    assert ann.nearest(df.limit(0)).collect() == []
    few = ann.nearest(df.where("vec_id in (0, 1, 2)")).collect()
    assert sorted((r.query_id, r.rank) for r in few) == [(0, 1), (0, 2)]


def test_equal_vectors_are_one_code_and_ties_go_to_smaller_ids(spark):
    """A vector that most rows share: every query gets the smallest ids that aren't its own."""
    rng = np.random.default_rng(8)
    common = [float(x) for x in rng.standard_normal(12)]
    rows = [(i, common if i % 3 else [float(x) for x in rng.standard_normal(12)]) for i in range(300)]
    rows += [(50, common)] * 3 + [(1, common)] * 9
    clash = [(*r, 1, b"x", 2, 3.0, [1.0], -1.0, [7]) for r in rows]
    df = spark.createDataFrame(clash, "vec_id long, embedding array<float>, rid int, code binary, dim int, correction double, q array<double>, floor double, ids array<int>")
    assert ann._distinct(ann.usable(df), 5).count() == 101
    got = {}
    for r in ann.nearest(df, 5, 50, block_rows=16).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 9)))
    assert {q: [i for i, _ in x] for q, x in got.items() if q % 3} == {50: [1] * 5, 100: [1] * 5, 200: [1] * 5, 250: [1] * 5}
    vec = {i: np.array(np.float32(v), float) for i, v in rows}
    for q in (0, 150):
        cos = sorted((-round(float(vec[q] @ np.float32(v).astype(float) / np.linalg.norm(vec[q]) / np.linalg.norm(np.float32(v).astype(float))), 9), i) for i, v in rows if i != q)[:5]
        assert got[q] == [(i, -c) for c, i in cos]


def test_only_pairs_that_reach_the_floor_are_fetched(spark, monkeypatch):
    """On clustered vectors few pairs go to the exact rerank."""
    rng, seen = np.random.default_rng(9), []
    centres = rng.standard_normal((20, 48))
    rows = [(i, [float(x) for x in centres[i % 20] + 0.3 * rng.standard_normal(48)]) for i in range(1000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    plain = ann.staged
    monkeypatch.setattr(ann, "staged", lambda d, label: seen.append((label, out := plain(d, label))) or out)
    got = ann.nearest(df).collect()
    assert len(got) == 100 and dict(seen)["pairs"].count() < 0.1 * 20 * 1000
    assert {n: d.columns for n, d in seen}["codes"] == ["rid", "dim", "only", "code", "correction"]


def test_bounds_hold(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((500, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    for turn in (ann.rotation(64), ann.rotation(64, 64)):
        assert np.allclose(turn @ turn.T, np.eye(64))
        packed, correction = ann.codes(x, turn)
        near, error = ann.bounds(packed, correction, x[:50] @ turn, 3.0)
        assert (np.abs(near - x[:50] @ x.T) <= error).mean() > 0.995
        near, error = ann.bounds(packed, correction, x[:50] @ turn, math.inf)
        assert (np.abs(near - x[:50] @ x.T) <= error).all()


def test_pipeline(spark):
    import corpus_pipeline

    df = spark.read.parquet(f"{SF}/documents.parquet")
    docs, seen = df, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == df.columns, name
        docs = spark.createDataFrame(docs.collect(), df.schema)
        seen.append((name, docs.count()))
    assert seen[0][1] < 200 and seen[1][1] < seen[0][1] and seen[2][1] == seen[1][1]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    whole = corpus_pipeline.run(spark, SF).collect()
    same(last, whole)


def test_stages_take_odd_rows(spark):
    import corpus_pipeline

    df, _ = documents(spark)
    for name, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, SF)
        assert df.collect() is not None, name
        if df.isEmpty():
            break


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_queries(spark, name):
    out = queries.queries()[name](spark, SF)
    assert out.count() > 0
    if name in queries.oracle_sql():
        import duckdb

        con = duckdb.connect()
        for t in ("documents", "embeddings", "pages", "conversations"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        r = con.execute(queries.oracle_sql()[name])
        names = [c[0] for c in r.description]
        assert sorted(names) == sorted(out.columns)
        short = lambda v: round(v, 9) if isinstance(v, float) else tuple(v) if isinstance(v, list) else v
        same([tuple(short(v) for v in x) for x in r.fetchall()], [tuple(short(x[c]) for c in names) for x in out.collect()])


def test_replicas_with_columns_of_the_report(spark):
    rows = [(0, i, i * 10, i * 10 + 10, bytearray(b"r%d" % i), f"s{i}", "x", "y") for i in range(9)]
    layout = "file long, idx long, start long, stop long, record binary, status string, record_sha256 string, own_status string"
    other = [(*r[:4], bytearray(b"z"), *r[5:]) if r[1] == 4 else r for r in rows if r[1] != 7]
    a, b = spark.createDataFrame(rows, layout), spark.createDataFrame(other, layout)
    for x, y, want in ((a, b, {4: "corrupt", 7: "missing"}), (a, a, {}), (a, a.limit(0), {i: "missing" for i in range(9)}), (a.limit(0), a, {i: "extra" for i in range(9)})):
        out = warc.audit(x, y).collect()
        assert {r.idx: (r.own_own_status, r.own_status, r.own_record_sha256, r.status) for r in out} == {i: (f"s{i}", "y", "x", want.get(i, "intact")) for i in range(9)}
    assert warc.audit(a.limit(0), a.limit(0)).columns[-2:] == ["record_sha256", "status"]
