"""Records, segments, replay, decoding in batch and as a stream."""

import random
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row
from pyspark.sql import functions as F

from tessera import queries
from tessera.operators import blocks as blocks_of
from tessera.operators import replay
from tessera.sources import pages, wal
from tessera.sources.tables import work_path
from tessera.streaming import decode

SIZE = 1 << 16


def load(spark, segments, **options):
    folder = work_path(spark, "wal")
    wal.write_segments(spark, segments, folder)
    return wal.read_log(spark, folder, size=segments.size, **options)


def insert(xid, block, value, rel=1, offnum=1):
    return wal.Record(replay.HEAP, 0, xid, struct.pack("<HB", offnum, 0), [wal.Block(0, rel, block, data=bytes(24) + value)])


def delete(xid, block, rel=1, offnum=1):
    return wal.Record(replay.HEAP, 0x10, xid, struct.pack("<IHBB", xid, offnum, 0, 0), [wal.Block(0, rel, block)])


def update(xid, old, new, value, rel=1, image=None):
    blocks = [wal.Block(0, rel, new, data=bytes(24) + value, image=image, image_flags=wal.APPLY if image else 0)]
    return wal.Record(replay.HEAP, 0x20, xid, struct.pack("<HBBHH", 1, 0, 0, 1, 0), [*blocks, wal.Block(1, rel, old)])


def end(xid, commit=True):
    return wal.Record(replay.XACT, 0 if commit else 0x20, xid)


def log(*records, size=SIZE):
    out = wal.Segments(size=size)
    for r in records:
        out.append(r)
    return out


def values(df):
    return sorted(r.v for r in df.select(replay.payload(F.col("tuple")).cast("string").alias("v")).collect())


def test_crc():
    assert wal.crc32c(b"123456789") == 0xE3069283 == wal.crc32c(b"1234", b"56789")


blocks = st.lists(st.builds(wal.Block, id=st.just(0), rel=st.integers(0, 3), block=st.integers(0, 2**32 - 1), spc=st.integers(0, 2), fork=st.integers(0, 3), data=st.binary(max_size=60), image=st.none() | st.binary(max_size=40), hole_offset=st.integers(0, 8000), hole_length=st.integers(0, 8191), image_flags=st.integers(0, 7)), max_size=4)


@settings(deadline=None, max_examples=80)
@given(st.integers(0, 255), st.integers(0, 255), st.integers(0, 2**32 - 1), st.binary(max_size=300) | st.integers(250, 260).map(bytes), blocks)
def test_record_round_trip(rmgr, info, xid, main, refs):
    for k, b in enumerate(refs):
        b.id = k
        if b.image is None:
            b.hole_offset = b.hole_length = b.image_flags = 0
        elif not b.image_flags & wal.HAS_HOLE:
            b.hole_length = 0
    data = wal.encode(wal.Record(rmgr, info, xid, main, refs))
    got = wal.decode(data, 77)
    assert len(data) % 8 == 0 and (got.rmgr_id, got.info, got.xid, got.main_data, got.lsn) == (rmgr, info, xid, main, 77)
    strip = lambda b: {k: v for k, v in b.row().items() if k != "flags"}
    assert list(map(strip, got.blocks)) == list(map(strip, refs))


def test_bad_records():
    data = bytearray(wal.encode(insert(5, 0, b"x")))
    data[30] ^= 1
    with pytest.raises(wal.LogError, match="CRC"):
        wal.decode(bytes(data), 0)
    with pytest.raises(wal.LogError, match="short"):
        wal.decode(b"x" * 10, 0)
    with pytest.raises(wal.LogError, match="instead of"):
        list(wal.records_in(bytes(100), 0, 1, SIZE))
    with pytest.raises(wal.LogError, match="timeline"):
        list(wal.records_in(next(log(insert(5, 0, b"x")).files())[1], 0, 2, SIZE))
    assert wal.restored(b"abcd", 2, 4, 10) == b"ab\0\0\0\0cd\0\0"


def test_segments_and_ranges(spark):
    written = [insert(5 + k, k, bytes([65 + k % 26]) * (k * 37 % 3000)) for k in range(150)]
    segments = log(*written)
    assert len(segments.data) > 2
    rows = load(spark, segments).orderBy("lsn").collect()
    assert [(r.lsn, r.xid, bytes(r.block_refs[0].data)) for r in rows] == [(w.lsn, w.xid, w.blocks[0].data) for w in written]
    assert [r.prev_lsn for r in rows] == [0, *(w.lsn for w in written[:-1])]
    cut = load(spark, segments, start=written[40].lsn, end=written[90].lsn)
    assert [r.xid for r in cut.orderBy("lsn").collect()] == [w.xid for w in written[40:90]]


def test_missing_segment_just_ends(spark):
    segments = log(*(insert(5, k, b"v" * 2000) for k in range(80)))
    del segments.data[1]
    assert 0 < load(spark, segments).count() < 80


def test_crash_recovery(spark):
    got = load(spark, log(insert(10, 0, b"committed-a"), end(10), insert(11, 1, b"open"), insert(12, 2, b"committed-b"), end(12)))
    assert values(replay.recovered(got)) == ["committed-a", "committed-b"]
    got = load(spark, log(insert(20, 0, b"gone"), end(20, False), insert(21, 1, b"present"), end(21)))
    assert values(replay.recovered(got)) == ["present"]


def test_deletes_wait_for_commit(spark):
    start = [insert(10, 0, b"a"), insert(10, 1, b"b"), insert(10, 2, b"c"), end(10)]
    got = load(spark, log(*start, delete(11, 0), delete(12, 1), end(12), update(13, 2, 5, b"c2"), end(13)))
    assert values(replay.recovered(got)) == ["a", "c2"]


def test_replay_is_idempotent(spark):
    got = load(spark, log(insert(10, 0, b"a"), update(10, 0, 1, b"b"), delete(10, 1), insert(10, 1, b"again"), end(10)))
    once = sorted(map(tuple, replay.redo(got).collect()))
    assert once == sorted(map(tuple, replay.redo(got.unionByName(got)).collect())) and values(replay.recovered(got)) == ["again"]


def test_image_on_the_new_block_spares_the_old_place(spark):
    image = pages.image_of([pages.row(11, b"new")])
    got = load(spark, log(insert(10, 0, b"old"), end(10), update(11, 0, 9, b"new", image=image), end(11)))
    assert values(replay.recovered(got)) == ["new"]  # the new row is in the image
    got = load(spark, log(insert(10, 0, b"old"), end(10), update(11, 0, 9, b"new", image=b"no page"), end(11, False)))
    assert values(replay.recovered(got)) == ["old"]


def test_image_rows(spark):
    """Rows of an image, by their own headers, and what comes after it; a hole is filled with zeros."""
    page = pages.image_of([pages.row(10, b"a"), None, pages.row(10, b"gone", xmax=11), 1, pages.row(10, b"kept", xmax=12), pages.row(7, b"frozen", mask=pages.XMIN_FROZEN), pages.row(10, b"alive", xmax=11, mask=pages.XMAX_INVALID)])
    ref = wal.Block(0, 1, 0, image=page[:60] + page[1060:], hole_offset=60, hole_length=1000, image_flags=wal.APPLY | wal.HAS_HOLE)
    got = load(spark, log(insert(10, 0, b"lost", offnum=9), wal.Record(replay.XLOG, 0xB0, 0, blocks=[ref]), insert(13, 0, b"after", offnum=8), delete(13, 0, offnum=1), end(10), end(11), end(12, False), end(13)))
    assert values(replay.recovered(got)) == ["after", "alive", "frozen", "kept"]
    assert {(r.offnum, r.state, r.target) for r in blocks_of.chain(replay.redo_pages(got)).collect()} == {(2, "dead", 0), (4, "redirect", 1)}


def test_prune_vacuum_visible(spark):
    prune = wal.Record(replay.HEAP2, 0x10, 9, struct.pack("<IHH", 0, 1, 1), [wal.Block(0, 1, 0, data=struct.pack("<HHH", 1, 4, 2))])
    vacuum = wal.Record(replay.HEAP2, 0x20, 9, struct.pack("<HHH", 2, 3, 7), [wal.Block(0, 1, 0)])
    seen = wal.Record(replay.HEAP2, 0x40, 9, blocks=[wal.Block(0, 1, 0)])
    noop = [wal.Record(replay.HEAP2, op, 9, blocks=[wal.Block(0, 1, 0)]) for op in (0x00, 0x30, 0x60, 0x70)]
    got = load(spark, log(*(insert(10, 0, bytes([96 + k]), offnum=k) for k in range(1, 5)), end(10), prune, vacuum, seen, *noop))
    assert values(replay.recovered(got)) == ["d"]
    page = replay.redo_pages(got.unionByName(got)).first()
    assert page.all_visible and {(x.offnum, x.state, x.target) for x in page["items"] if x.tuple is None} == {(1, pages.REDIRECT, 4), (2, pages.DEAD, 0), (3, pages.DEAD, 0), (7, pages.DEAD, 0)}
    assert page.page_lsn == got.where("rmgr_id = 9 and info = 64").first().lsn


def test_index_records(spark):
    put = lambda number, key, op=0x00, block=0: wal.Record(replay.BTREE, op, 9, struct.pack("<H", number), [wal.Block(0, 5, block, data=pages.entry(key))])
    root = wal.Block(0, 5, 3, image=pages.image_of([pages.entry(b"m")], level=1), image_flags=wal.APPLY)
    split = wal.Record(replay.BTREE, 0x50, 9, struct.pack("<IHHH", 0, 3, 0, 0), [wal.Block(0, 5, 0), wal.Block(1, 5, 1, data=pages.entry(b"x") + pages.entry(b"y") + b"\1\2")])
    got = load(spark, log(put(1, b"b", 0x08), put(1, b"a"), put(3, b"c", 0xF0), put(2, b"ab", 0x20), put(1, b"up", 0x18, 2), split, wal.Record(replay.BTREE, 0xC0, 9, blocks=[root]), wal.Record(replay.BTREE, 0x70, 9, blocks=[wal.Block(0, 5, 0)])))
    rows = blocks_of.entries_of(replay.redo_pages(got)).orderBy("block", "offnum").collect()
    assert [(r.block, r.level, r.leaf, r.before, bytes(r.key)) for r in rows] == [
        (0, 0, True, None, b"a"), (0, 0, True, None, b"ab"), (0, 0, True, None, b"b"), (0, 0, True, None, b"c"), (1, 0, True, 0, b"x"), (1, 0, True, 0, b"y"), (2, 1, False, None, b"up"), (3, 1, False, None, b"m"),
    ]


def test_registered_manager(spark):
    def count(page, record):
        page.items[len(page.items) + 1] = pages.Item(pages.NORMAL, record["main_data"], record["xid"])

    registry = replay.registered(77, replay.Manager("Counter", 0xF0, {0x10: "TICK"}, count))
    got = load(spark, log(insert(10, 0, b"a"), *(wal.Record(77, 0x10, 5, b"t%d" % k, [wal.Block(0, 2, 0)]) for k in range(3)), wal.Record(78, 0, 5)))
    assert {(r.rmgr, r.op, r.applied, r.skip_reason) for r in replay.described(got, registry).collect()} == {("Heap", "INSERT", True, None), ("Counter", "TICK", True, None), ("Rmgr(78)", "op=0x00", False, "unknown")}
    assert sorted(bytes(r.tuple) for r in replay.redo(got, registry).where("rel = 2").collect()) == [b"t0", b"t1", b"t2"]
    assert replay.redo(got).where("rel = 2").count() == 0
    with pytest.raises(ValueError, match="taken"):
        replay.registered(replay.HEAP, replay.Manager("again"))


def test_checksums():
    data = [bytes((k * j) % 256 for j in range(n)) for k, n in enumerate([0, 1, 3, 4, 5, 20, 21, 8192, *([40, 55, 63] * 30), *([700] * 40)])]
    assert wal.checksums(data) == [wal.crc32c(x) for x in data]


def test_only_files_in_range_are_read(spark):
    segments = log(*(insert(5, k, b"v" * 2000) for k in range(150)))
    names = [n for n, _ in segments.files()]
    folder = work_path(spark, "wal")
    wal.write_segments(spark, segments, folder)
    read = wal.read_log(spark, folder, size=SIZE, start=SIZE, end=2 * SIZE)
    assert len(names) > 3 and [x.rpartition("/")[2] for x in read.inputFiles()] == [names[1]]
    assert read.count() > 10 and wal.read_log(spark, folder, size=SIZE, start=100 * SIZE).count() == 0


def test_long_transactions_are_split(spark):
    """Ends and numbers are the same however long the stretches are that are ordered together."""
    random.seed(5)
    rows = [(random.randint(1, 5), 8 * k, random.choices(["INSERT", "DELETE", "UPDATE", "COMMIT", "ABORT"], [30, 20, 20, 2, 1])[0]) for k in range(3000)]
    frame = spark.createDataFrame(rows, "xid long, lsn long, op string")
    whole = sorted(map(tuple, replay.decoded(frame).select("xid", "commit_lsn", "lsn", "op", "seq").collect()))
    assert whole == sorted(map(tuple, replay.decoded(frame, 64).select("xid", "commit_lsn", "lsn", "op", "seq").collect())) and len(whole) > 1000
    assert sorted(map(tuple, replay.pending(frame).collect()))


def test_delivered(spark):
    """A user's function gets each batch of committed changes in order."""
    source, folder = work_path(spark, "log"), work_path(spark, "state")
    rows = [(1, 8, "INSERT"), (2, 16, "INSERT"), (1, 24, "DELETE"), (1, 32, "COMMIT"), (2, 40, "ABORT"), (3, 48, "UPDATE"), (3, 56, "COMMIT")]
    spark.createDataFrame(rows, "xid long, lsn long, op string").coalesce(1).write.parquet(source)
    seen = []
    provider = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        decode.delivered(spark.readStream.schema("xid long, lsn long, op string").parquet(source), lambda batch, number: seen.extend((number, *r) for r in batch.collect()), folder).awaitTermination()
    finally:
        spark.conf.unset(provider)
    assert seen == [(0, 1, 32, 8, "INSERT", 1), (0, 1, 32, 24, "DELETE", 2), (0, 3, 56, 48, "UPDATE", 1)]


def test_image_replaces_what_its_block_held(spark):
    page = wal.Record(replay.XLOG, 0xB0, 0, blocks=[wal.Block(0, 1, 0, image=b"p", image_flags=wal.APPLY)])
    got = load(spark, log(insert(10, 0, b"before"), insert(10, 1, b"other"), page, insert(10, 0, b"after", offnum=2), end(10)))
    assert values(replay.recovered(got)) == ["after", "other"]


def test_multi_insert(spark):
    parts, data = [b"one", b"three!", b"", b"z"], b""
    for p in parts:
        data += bytes(len(data) % 2) + struct.pack("<HHHB", len(p), 0, 0, 24) + p
    record = wal.Record(replay.HEAP2, 0x50, 9, struct.pack("<BBH", 0, 0, len(parts)), [wal.Block(0, 1, 3, data=data)])
    got = load(spark, log(record, end(9)))
    rows = replay.changes(got).orderBy("seq").collect()
    assert [bytes(r.tuple)[24:] for r in rows] == parts and [r.offnum for r in rows] == [1, 2, 3, 4]
    assert replay.decoded(replay.log_of(got)).count() == 4


def test_decoding_order(spark):
    got = load(spark, log(insert(1, 0, b"a"), insert(2, 1, b"b"), insert(1, 2, b"c"), end(1), end(2), delete(3, 0), end(4), insert(3, 4, b"d")))
    changes = replay.decoded(replay.log_of(got)).orderBy("commit_lsn", "seq").collect()
    assert [(r.xid, r.op, r.seq) for r in changes] == [(1, "INSERT", 1), (1, "INSERT", 2), (2, "INSERT", 1)]
    assert [tuple(r) for r in replay.pending(replay.log_of(got)).collect()] == [(3, 2)]


def test_ids_come_again(spark):
    rows = [(1, 10, "INSERT"), (1, 20, "ABORT"), (1, 30, "INSERT"), (1, 40, "UPDATE"), (1, 50, "COMMIT"), (1, 60, "DELETE")]
    got = replay.decoded(spark.createDataFrame(rows, "xid long, lsn long, op string"))
    assert [(r.commit_lsn, r.lsn, r.seq) for r in got.orderBy("lsn").collect()] == [(50, 30, 1), (50, 40, 2)]


def test_descriptions(spark):
    rows = spark.createDataFrame([(0, 0x80, 30), (1, 0x30, 24), (10, 0xC0, 50), (9, 0x50, 40), (6, 0, 24), (99, 0x77, 24)], "rmgr_id int, info int, tot_len long")
    got = [(r.rmgr, r.op, r.applied, r.skip_reason) for r in replay.described(rows).collect()]
    assert got == [("XLOG", "FPW", True, None), ("Transaction", "COMMIT_PREPARED", True, None), ("Heap", "HOT_UPDATE", True, None), ("Heap2", "MULTI_INSERT", True, None), ("MultiXact", "op=0x00", False, "not applied"), ("Rmgr(99)", "op=0x70", False, "unknown")]
    assert {r.rmgr: r.skipped for r in replay.summary(rows).collect()}["Rmgr(99)"] == 1


def test_stream_equals_batch(spark):
    sf = "/root/testdata/sf0.001"
    key = lambda q: sorted(map(tuple, q(spark, sf).select("xid", "commit_lsn", "lsn", "op", "seq").collect()))
    assert key(queries.logical_stream) == key(queries.logical_decode)


def test_stream_reads_state_only_at_ends():
    """Rows without an end are appended to the state; what is open is read for a COMMIT and dropped for an ABORT."""

    class State(list):
        reads = writes = 0

        def get(self):
            self.reads += 1
            return iter(list(self))

        def appendList(self, rows):
            self.writes += len(rows)
            self += rows

        def put(self, rows):
            self.writes += len(rows)
            self[:] = rows

    state, buffer = State(), decode.Buffer()
    buffer.open = state
    run = lambda *rows: [tuple(r) for r in buffer.handleInputRows((7,), iter([Row(xid=7, lsn=a, op=b) for a, b in rows]), None)]
    for k in range(100):
        assert run((2 * k + 2, "UPDATE"), (2 * k + 1, "INSERT")) == []
    assert (state.reads, state.writes, len(state)) == (0, 200, 200)
    got = run((500, "INSERT"), (501, "COMMIT"), (502, "DELETE"))
    assert got == [(7, 501, n, "INSERT" if n % 2 else "UPDATE", n) for n in range(1, 201)] + [(7, 501, 500, "INSERT", 201)]
    assert state == [(502, "DELETE")] and run((503, "ABORT"), (504, "INSERT"), (505, "COMMIT")) == [(7, 505, 504, "INSERT", 1)]
    assert state == [] and state.reads == 1


def test_stream_settings_and_empty_log(spark, tmp_path):
    """With more shuffle partitions than cores the rows are the same, and the session's settings come back; an empty log gives no rows."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        rows = [(k, k % 3, "click" if k % 5 else "purchase") for k in range(40)]
        spark.createDataFrame(rows, "event_id long, user_id long, event_type string").write.parquet(f"{tmp_path}/a/events.parquet")
        spark.createDataFrame([], "event_id long, user_id long, event_type string").write.parquet(f"{tmp_path}/b/events.parquet")
        key = lambda q, d: sorted(map(tuple, q(spark, f"{tmp_path}/{d}").select("xid", "commit_lsn", "lsn", "op", "seq").collect()))
        assert key(queries.logical_stream, "a") == key(queries.logical_decode, "a") != []
        assert key(queries.logical_stream, "b") == []
        assert spark.conf.get("spark.sql.shuffle.partitions") == "40"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_command_line(spark):
    from tessera import __main__ as command

    folder = work_path(spark, "wal")
    wal.write_segments(spark, log(insert(10, 0, b"a"), insert(10, 1, b"b"), end(10), wal.Record(6, 0, 0)), folder)
    got = {r.rmgr: (r.applied, r.skipped) for r in command.summarised(spark, folder).collect()}
    assert got == {"Heap": (2, 0), "Transaction": (1, 0), replay.MANAGERS[6]: (0, 1)}
    assert command.position("1/2A") == 0x1_0000_002A and command.position("42") == 42
    with pytest.raises(wal.LogError, match="sizes"):
        command.segment_size(spark, "/root/testdata/sf0.001")
