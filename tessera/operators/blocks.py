"""Redo of blocks: each block's records, in log order, become the page that it holds after them."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources import pages, wal

ITEM = "struct<offnum:int,state:int,target:int,xmin:bigint,xmax:bigint,cid:bigint,lsn:bigint,tuple:binary>"
PLACE = ["spc", "db", "rel", "fork", "block"]
PAGES = f"spc long, db long, rel long, fork int, block long, page_lsn long, all_visible boolean, level long, leaf boolean, before long, after long, items array<{ITEM}>"
WANTED = [*PLACE, "lsn", "rmgr_id", "info", "xid", "main_data", "pos", "data", "image", "hole_offset", "hole_length", "image_flags", "others"]

#: What a record of a manager does to one of its blocks: (page, record as a dict) in place.
Redo = Callable[[pages.Page, dict], None]


def heap(page: pages.Page, r: dict) -> None:
    """Inserts, deletes and updates of rows. A delete, or an update's old place, names the transaction
    that ends the row; whether it counts is for the scan to say."""
    op, main, xid, lsn = r["info"] & 0x70, r["main_data"], r["xid"], r["lsn"]
    if op == 0x00:
        _put(page, struct.unpack_from("<H", main)[0], r)
    elif op == 0x10:
        _end(page, struct.unpack_from("<IH", main)[1], xid)
    elif op in (0x20, 0x40):
        old, _, _, new = struct.unpack_from("<HBBH", main)
        if r["pos"] == 1 or len(r["others"]) < 2:
            _end(page, old, xid)
        if r["pos"] == 0:
            _put(page, new, r)
    else:
        return
    page.lsn = lsn


def _put(page: pages.Page, number: int, r: dict) -> None:
    if r["info"] & 0x80:  # the record begins the page
        page.items.clear()
    page.items[number] = pages.Item(pages.NORMAL, r["data"], r["xid"], lsn=r["lsn"])


def _end(page: pages.Page, number: int, xid: int) -> None:
    if number in page.items and page.items[number].state == pages.NORMAL:
        page.items[number].xmax = xid


def heap2(page: pages.Page, r: dict) -> None:
    """Several rows at once, and what pruning, vacuum and the visibility map leave."""
    op, main, data = r["info"] & 0x70, r["main_data"], r["data"]
    if op == 0x50:
        if r["info"] & 0x80:
            page.items.clear()
        at, number = 0, max(page.items, default=0)
        for _ in range(struct.unpack_from("<H", main, 2)[0]):
            at += at % 2
            size, _, mask = struct.unpack_from("<HHH", data, at)
            at += 7 + size
            number += 1
            page.items[number] = pages.Item(pages.NORMAL, pages.row(r["xid"], data[at - size : at], mask=mask), r["xid"], lsn=r["lsn"])
    elif op == 0x10:
        moved, dead = struct.unpack_from("<HH", main, 4)
        numbers = struct.unpack_from(f"<{2 * moved + dead}H", data)
        for k in range(moved):
            page.items[numbers[2 * k]] = pages.Item(pages.REDIRECT, target=numbers[2 * k + 1], lsn=r["lsn"])
        for number in numbers[2 * moved :]:
            page.items[number] = pages.Item(pages.DEAD, lsn=r["lsn"])
    elif op == 0x20:
        for number in struct.unpack_from(f"<{struct.unpack_from('<H', main)[0]}H", main, 2):
            page.items[number] = pages.Item(pages.DEAD, lsn=r["lsn"])
    elif op == 0x40:
        page.all_visible = True
    else:
        return
    page.lsn = r["lsn"]


def btree(page: pages.Page, r: dict) -> None:
    """Entries put in their order, and the right page of a split. A split's left page stays as it was
    without an image, and a new root comes as an image only."""
    op, main, lsn = r["info"] & 0xF0, r["main_data"], r["lsn"]
    if op in (0x00, 0x10, 0x20, 0xF0) and r["pos"] == 0:
        if r["info"] & 0x08:
            page.items.clear()
            page.before = page.after = None
            page.leaf, page.level = op != 0x10, 0 if op != 0x10 else 1
        elif page.leaf is None:
            page.leaf, page.level = op != 0x10, 0 if op != 0x10 else 1
        page.place(struct.unpack_from("<H", main)[0], pages.Item(pages.NORMAL, r["data"], lsn=lsn))
    elif op in (0x30, 0x40, 0x50, 0x60) and r["pos"] == 1:
        page.items.clear()
        page.level = struct.unpack_from("<I", main)[0]
        page.leaf, page.before = page.level == 0, r["others"][0]
        page.after = r["others"][2] if len(r["others"]) > 2 else None
        data, number = r["data"], 0
        while len(data) >= pages.ENTRY_HEADER:
            size = struct.unpack_from("<H", data, 6)[0] & pages.ENTRY_SIZE
            if not pages.ENTRY_HEADER <= size <= len(data):
                break
            number += 1
            page.items[number], data = pages.Item(pages.NORMAL, data[:size], lsn=lsn), data[size:]
    else:
        return
    page.lsn = lsn


def is_image(flags: Column, image: Column) -> Column:
    """Whether a block's image is to be applied."""
    return F.coalesce(image.isNotNull() & (flags.bitwiseAND(F.lit(wal.APPLY)) != 0), F.lit(False))


def touched(records: DataFrame, managers: list[int]) -> DataFrame:
    """A row for each block that a record of these managers touches, without those that a later image
    of the block makes void. Repeated records count once."""
    once = records.where(F.col("rmgr_id").isin(managers)).dropDuplicates(["lsn"])
    rows = once.select("lsn", "rmgr_id", "info", "xid", "main_data", F.transform("block_refs", lambda b: b["block"]).alias("others"), F.posexplode("block_refs").alias("pos", "b"))
    rows = rows.select("lsn", "rmgr_id", "info", "xid", "main_data", "others", "pos", "b.*")
    images = rows.where(is_image(F.col("image_flags"), F.col("image"))).groupBy(*PLACE).agg(F.max("lsn").alias("image_lsn"))
    return rows.join(images, PLACE, "left").where("image_lsn is null or lsn >= image_lsn").select(*WANTED)


def redone(records: DataFrame, redo: dict[int, Redo]) -> DataFrame:
    """PAGES: each block after its records, in log order. `redo` says what each manager's records do.
    A block's records since its last image are folded in one task; blocks are spread over all."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(PAGES))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, page, out = None, None, []
        for batch in batches:
            for r in batch.to_pylist():
                now = tuple(r[c] for c in PLACE)
                if now != place:
                    if place is not None:
                        out.append(shown(place, page))
                    place, page = now, pages.Page()
                if r["image"] is not None and r["image_flags"] & wal.APPLY:
                    page = pages.parsed(wal.restored(r["image"], r["hole_offset"], r["hole_length"]), r["lsn"])
                else:
                    redo[r["rmgr_id"]](page, r)
            if len(out) >= 256:
                yield pa.RecordBatch.from_pylist(out, schema=target)
                out = []
        if place is not None:
            out.append(shown(place, page))
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=target)

    rows = touched(records, sorted(redo))
    return rows.repartition(*PLACE).sortWithinPartitions(*PLACE, "lsn", "pos").mapInArrow(fold, PAGES)


def shown(place: tuple, page: pages.Page) -> dict:
    items = [{"offnum": k, "state": x.state, "target": x.target, "xmin": x.xmin, "xmax": x.xmax, "cid": x.cid, "lsn": x.lsn, "tuple": x.data} for k, x in sorted(page.items.items())]
    return dict(zip(PLACE, place, strict=True)) | {"page_lsn": page.lsn, "all_visible": page.all_visible, "level": page.level, "leaf": page.leaf, "before": page.before, "after": page.after, "items": items}


def rows_of(found: DataFrame) -> DataFrame:
    """The row versions on table pages: rel, fork, block, offnum, xmin, xmax, cid, tuple, lsn."""
    each = found.where("level is null").select("rel", "fork", "block", F.explode("items").alias("i")).where(F.col("i.state") == pages.NORMAL)
    return each.select("rel", "fork", "block", "i.offnum", "i.xmin", "i.xmax", "i.cid", "i.tuple", "i.lsn")


def entries_of(found: DataFrame) -> DataFrame:
    """The entries on index pages, in order by offnum, with their page's level and siblings."""
    each = found.where("level is not null").select("rel", "block", "level", "leaf", "before", "after", F.explode("items").alias("i")).where(F.col("i.state") == pages.NORMAL)
    return each.select("rel", "block", "level", "leaf", "before", "after", "i.offnum", F.substring("i.tuple", pages.ENTRY_HEADER + 1, 1 << 30).alias("key"))


def chain(found: DataFrame) -> DataFrame:
    """Places that pruning leaves: rel, block, offnum, state, target (a redirect's)."""
    each = found.where("level is null").select("rel", "block", F.explode("items").alias("i")).where(F.col("i.state") != pages.NORMAL)
    return each.select("rel", "block", "i.offnum", F.when(F.col("i.state") == pages.REDIRECT, "redirect").otherwise("dead").alias("state"), F.col("i.target").alias("target"))


