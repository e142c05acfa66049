"""Writing documents: objects in order, and the cross references that a reader starts from."""

from __future__ import annotations

import zlib
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

HEADER = b"%PDF-1.7\n"
#: Objects in one object stream of a packed document.
GROUP = 100
Objects = Iterable[tuple[int, int, bytes]]


def cross_references(entries: dict[int, tuple[int, int]]) -> bytes:
    """A table of runs of neighbouring numbers; object 0 heads the free ones."""
    runs: list[list[bytes]] = [[b"0000000000 65535 f \n"]]
    firsts, last = [0], 0
    for n in sorted(entries):
        if n:
            if n != last + 1:
                runs.append([])
                firsts.append(n)
            runs[-1].append(b"%010d %05d n \n" % entries[n])
            last = n
        else:
            runs[0][0] = b"%010d %05d n \n" % entries[0]
    return b"xref\n" + b"".join([b"%d %d\n%b" % (first, len(run), b"".join(run)) for first, run in zip(firsts, runs, strict=True)])


def canonical(objects: Objects, trailer: str) -> bytes:
    """Every object as it is, a table of where each stands, and a trailer. Of a number that comes twice the table has the later place."""
    parts, at, entries = [HEADER], len(HEADER), {}
    for num, gen, body in objects:
        whole = b"%d %d obj\n%b\nendobj\n" % (num, gen, body)
        entries[num] = (at, gen)
        parts.append(whole)
        at += len(whole)
    tail = f"trailer\n<< /Size {max(entries, default=0) + 1} {trailer} >>\nstartxref\n{at}\n%%EOF\n".encode("latin-1")
    return b"".join([*parts, cross_references(entries), tail])


def packed(objects: Objects, trailer: str) -> bytes:
    """Objects without streams in object streams, and a cross-reference stream in place of the table and the trailer."""
    parts, at = [HEADER], len(HEADER)
    rows: dict[int, tuple[int, int, int]] = {0: (0, 0, 65535)}
    loose: list[tuple[int, bytes]] = []
    last = 0

    def put(num: int, gen: int, body: bytes) -> None:
        nonlocal at
        whole = b"%d %d obj\n" % (num, gen) + body + b"\nendobj\n"
        rows[num] = (1, at, gen)
        parts.append(whole)
        at += len(whole)

    def stream(entries: str, data: bytes) -> bytes:
        data = zlib.compress(data)
        return f"<< {entries} /Filter /FlateDecode /Length {len(data)} >>\nstream\n".encode("latin-1") + data + b"\nendstream"

    for num, gen, body in objects:
        last = max(last, num)
        if gen or b"endstream" in body[-12:]:
            put(num, gen, body)
        else:
            loose.append((num, body))
    for i in range(0, len(loose), GROUP):
        group, last = loose[i : i + GROUP], last + 1
        begins, inside = [], b""
        for k, (num, body) in enumerate(group):
            begins.append(f"{num} {len(inside)}")
            inside += body + b"\n"
            rows[num] = (2, last, k)
        header = (" ".join(begins) + "\n").encode()
        put(last, 0, stream(f"/Type /ObjStm /N {len(group)} /First {len(header)}", header + inside))
    last += 1
    rows[last] = (1, at, 0)
    table = b"".join(bytes([k]) + a.to_bytes(5, "big") + b.to_bytes(2, "big") for k, a, b in (rows.get(n, (0, 0, 0)) for n in range(last + 1)))
    start = at
    put(last, 0, stream(f"/Type /XRef /Size {last + 1} /W [1 5 2] {trailer}", table))
    return b"".join([*parts, f"startxref\n{start}\n%%EOF\n".encode()])


def written(objects: Column, trailer: Column, pack: Column) -> Column:
    """The file. objects: an array of struct(num int, gen int, body binary) in file order; trailer: its entries but for /Size."""

    @F.arrow_udf("binary")
    def apply(o: pa.Array, t: pa.Array, p: pa.Array) -> pa.Array:
        flat = list(zip(*(c.to_pylist() for c in o.flatten().flatten()), strict=True))
        sizes = o.value_lengths().to_pylist()
        out, at = [], 0
        for n, s, b in zip(sizes, t.to_pylist(), p.to_pylist(), strict=True):
            out.append((packed if b else canonical)(flat[at : at + n], s))
            at += n
        return pa.array(out, pa.binary())

    return apply(objects, trailer, pack)
