"""HDF5 files by hand, for tests: an old form (superblock 0, symbol tables, headers of version 1) and a new one
(superblock 2, links and attributes in fractal heaps, headers of version 2)."""

import itertools
import struct
import zlib

import numpy as np

NONE = 2**64 - 1


def datatype(dtype):
    dtype = np.dtype(dtype)
    big = dtype.byteorder == ">"
    if dtype.kind in "iu":
        return struct.pack("<BBBBIHH", 0x10, big | (8 if dtype.kind == "i" else 0), 0, 0, dtype.itemsize, 0, 8 * dtype.itemsize)
    layout = {4: (23, 8, 23, 127), 8: (52, 11, 52, 1023)}[dtype.itemsize]
    return struct.pack("<BBBBIHHBBBBI", 0x11, 0x20 | big, 8 * dtype.itemsize - 1, 0, dtype.itemsize, 0, 8 * dtype.itemsize, layout[0], layout[1], 0, layout[2], layout[3])


def text_type(n):
    return struct.pack("<BBBBI", 0x13, 0, 0, 0, n)


REFERENCES = struct.pack("<BBBBI", 0x19, 0, 0, 0, 16) + struct.pack("<BBBBI", 0x17, 0, 0, 0, 8)


def dataspace(shape, version):
    if version == 1:
        return struct.pack("<BBB5x", 1, len(shape), 0) + b"".join(struct.pack("<Q", s) for s in shape)
    return struct.pack("<BBBB", 2, len(shape), 0, 1 if shape else 0) + b"".join(struct.pack("<Q", s) for s in shape)


class Writer:
    def __init__(self, new, chunks_a_node=2, links_a_node=None):
        self.new, self.out, self.chunks_a_node = new, bytearray(1024), chunks_a_node
        self.named, self.refs = {}, []

    def put(self, raw):
        self.out += b"\0" * (-len(self.out) % 8)
        at = len(self.out)
        self.out += raw
        return at

    # --- attributes -----------------------------------------------------------------------------------------------
    def attribute(self, name, value):
        name = name.encode() + b"\0"
        if isinstance(value, str):
            kind, space, data = text_type(len(value)), dataspace((), 2 if self.new else 1), value.encode()
        elif isinstance(value, list):  # names of dimensions: sequences of references
            heap_objects = b"".join(struct.pack("<HH4xQQ", i + 1, 1, 8, self.named[d]) for i, d in enumerate(value))
            heap = self.put(b"GCOL" + struct.pack("<B3xQ", 1, 4096) + (heap_objects + struct.pack("<HH4xQ", 0, 0, 4096 - 16 - len(heap_objects))).ljust(4080, b"\0"))
            kind, space = REFERENCES, dataspace((len(value),), 2 if self.new else 1)
            data = b"".join(struct.pack("<IQI", 1, heap, i + 1) for i in range(len(value)))
        else:
            value = np.asarray(value)
            kind, space, data = datatype(value.dtype), dataspace((1,), 2 if self.new else 1), value.tobytes()
        if self.new:
            return struct.pack("<BBHHHB", 3, 0, len(name), len(kind), len(space), 0) + name + kind + space + data
        pad = lambda x: x + b"\0" * (-len(x) % 8)
        return struct.pack("<BBHHH", 1, 0, len(name), len(kind), len(space)) + pad(name) + pad(kind) + pad(space) + data

    # --- headers --------------------------------------------------------------------------------------------------
    def header(self, messages):
        """An object header whose last messages lie in a continuation."""
        if self.new:
            pack = lambda ms: b"".join(struct.pack("<BHB", k, len(m), 0) + m for k, m in ms)
            rest = pack(messages[1:])
            more = self.put(b"OCHK" + rest + b"\0" * 4)
            first = pack([messages[0], (16, struct.pack("<QQ", more, len(rest) + 8))])
            return self.put(b"OHDR" + struct.pack("<BBI", 2, 2, len(first)) + first + b"\0" * 4)
        pad = lambda x: x + b"\0" * (-len(x) % 8)
        pack = lambda ms: b"".join(struct.pack("<HHB3x", k, len(pad(m)), 0) + pad(m) for k, m in ms)
        rest = pack(messages[1:])
        more = self.put(rest)
        first = pack([messages[0], (16, struct.pack("<QQ", more, len(rest)))])
        return self.put(struct.pack("<BxHII4x", 1, len(messages) + 1, 1, len(first)) + first)

    def tree(self, entries, rank):
        """An index of chunks of two levels: entries (place in elements, address, size), sorted."""
        key = lambda place, size: struct.pack("<II", size, 0) + b"".join(struct.pack("<Q", p) for p in (*place, 0))
        end = tuple(p + 1 for p in entries[-1][0])

        def node(level, children, after):
            body = b"".join(key(place, size) + struct.pack("<Q", at) for place, at, size in children) + key(after, 0)
            return self.put(b"TREE" + struct.pack("<BBHQQ", 1, level, len(children), NONE, NONE) + body)

        groups = [entries[i : i + self.chunks_a_node] for i in range(0, len(entries), self.chunks_a_node)]
        leaves = [(g[0][0], node(0, g, groups[i + 1][0][0] if i + 1 < len(groups) else end), 0) for i, g in enumerate(groups)]
        return node(1, leaves, end)

    def dataset(self, name, values, chunks=None, deflate=False, fill=None, attrs=None, skip=()):
        values = np.asarray(values)
        kind, each = datatype(values.dtype), values.dtype.itemsize
        messages = [(1, dataspace(values.shape, 2 if self.new else 1)), (3, kind)]
        if fill is not None:
            raw = np.asarray(fill, values.dtype).tobytes()
            messages.append((5, struct.pack("<BBI", 3, 0x29, each) + raw if self.new else struct.pack("<BBBBI", 2, 2, 0, 1, each) + raw))
        if chunks:
            entries = []
            for at in itertools.product(*(range(-(-s // c)) for s, c in zip(values.shape, chunks))):
                if at in skip:
                    continue
                full = np.zeros(chunks, values.dtype)
                part = values[tuple(slice(i * c, (i + 1) * c) for i, c in zip(at, chunks))]
                full[tuple(slice(0, n) for n in part.shape)] = part
                raw = full.tobytes()
                if deflate:
                    raw = zlib.compress(np.frombuffer(raw, np.uint8).reshape(-1, each).T.tobytes()) + b"sum."
                entries.append((tuple(i * c for i, c in zip(at, chunks)), self.put(raw), len(raw)))
            if deflate:
                if self.new:
                    pipeline = struct.pack("<BB", 2, 3) + b"".join(struct.pack("<HHH", k, 0, len(v)) + struct.pack(f"<{len(v)}I", *v) for k, v in ((2, [each]), (1, [4]), (3, [])))
                else:
                    pipeline = struct.pack("<BB6x", 1, 3) + b"".join(struct.pack("<HHHH", k, 8, 0, len(v)) + b"filter\0\0" + struct.pack(f"<{len(v)}I", *v) + b"\0" * (4 * (len(v) % 2)) for k, v in ((2, [each]), (1, [4]), (3, [])))
                messages.append((11, pipeline))
            messages.append((8, struct.pack("<BBBQ", 3, 2, len(chunks) + 1, self.tree(entries, len(chunks))) + struct.pack(f"<{len(chunks) + 1}I", *chunks, each)))
        else:
            messages.append((8, struct.pack("<BBQQ", 3, 1, self.put(values.tobytes()), values.nbytes)))
        made = [self.attribute(k, v) for k, v in (attrs or {}).items()]
        if self.new and len(made) > 2:  # dense
            heap, ids = self.heap(made)
            tree = self.records(8, [i.ljust(8, b"\0") + struct.pack("<BII", 0, n, n) for n, i in enumerate(ids)])
            messages.append((21, struct.pack("<BBQQ", 0, 0, heap, tree)))
        else:
            messages += [(12, m) for m in made]
        self.named[name] = self.header(messages)

    # --- dense storage ----------------------------------------------------------------------------------------------
    def heap(self, objects):
        """A fractal heap of blocks of 512 bytes, four a row, and more in later rows; the ids of the objects."""
        width, first, most, place = 4, 512, 1024, 4
        sizes = [first << max(0, i // width - 1) for i in range(20)]
        starts = [sum(sizes[:i]) for i in range(20)]
        overhead, block, used, blocks, ids = 5 + 8 + place + 4, 0, 0, {}, []
        for raw in objects:
            if not used or used + len(raw) > sizes[block]:
                block, used = (block + 1 if blocks else 0), overhead
                blocks[block] = bytearray(sizes[block])
            blocks[block][used : used + len(raw)] = raw
            ids.append(b"\0" + struct.pack("<IH", starts[block] + used, len(raw)))
            used += len(raw)
        assert max(sizes[b] for b in blocks) <= most
        rows = max(blocks) // width + 1
        placed = {}
        for b, raw in blocks.items():
            raw[: 5 + 8 + place] = b"FHDB" + struct.pack("<BQI", 0, 0, starts[b])
            placed[b] = self.put(bytes(raw))
        if len(blocks) == 1:
            root, rows = placed[0], 0
        else:
            root = self.put(b"FHIB" + struct.pack("<BQI", 0, 0, 0) + b"".join(struct.pack("<Q", placed.get(i, NONE)) for i in range(rows * width)) + b"\0" * 4)
        head = b"FRHP" + struct.pack("<BHHBI", 0, 7, 0, 2, 4096) + struct.pack("<QQQQ", 0, NONE, 0, NONE) + struct.pack("<8Q", 0, 0, 0, len(objects), 0, 0, 0, 0)
        return self.put(head + struct.pack("<HQQHHQH", width, first, most, 32, 1, root, rows) + b"\0" * 4), ids

    def records(self, kind, records, node=128):
        """An index of the second kind, of one level or two."""
        size = len(records[0])
        most = (node - 10) // size
        leaf = lambda rs: self.put((b"BTLF" + struct.pack("<BB", 0, kind) + b"".join(rs) + b"\0" * 4).ljust(node, b"\0"))
        if len(records) <= most:
            root, held, depth = leaf(records), len(records), 0
        else:
            groups, middles, rest = [], [], list(records)
            while rest:
                groups.append(rest[:most])
                rest = rest[most:]
                if rest:
                    middles.append(rest.pop(0))
            pointers = b"".join(struct.pack("<QB", leaf(g), len(g)) for g in groups if g or True)
            root, held, depth = self.put((b"BTIN" + struct.pack("<BB", 0, kind) + b"".join(middles) + pointers + b"\0" * 4).ljust(node, b"\0")), len(middles), 1
            assert 6 + len(b"".join(middles)) + len(pointers) + 4 <= node
        return self.put(b"BTHD" + struct.pack("<BBIHHBBQHQ", 0, kind, node, size, depth, 85, 40, root, held, len(records)) + b"\0" * 4)

    # --- the file ---------------------------------------------------------------------------------------------------
    def save(self, path):
        names = sorted(self.named)
        if self.new:
            links = [struct.pack("<BBB", 1, 0, len(n)) + n.encode() + struct.pack("<Q", self.named[n]) for n in names]
            heap, ids = self.heap(links)
            tree = self.records(5, [struct.pack("<I", i) + x for i, x in enumerate(ids)])
            root = self.header([(2, struct.pack("<BBQQ", 0, 0, heap, tree)), (10, b"\0\0")])
            head = b"\x89HDF\r\n\x1a\n" + struct.pack("<BBBBQQQQI", 2, 8, 8, 0, 0, NONE, len(self.out), root, 0)
        else:
            text, places = b"\0" * 8, []
            for n in names:
                places.append(len(text))
                text += n.encode() + b"\0" * (8 - len(n) % 8)
            heap = self.put(b"HEAP" + struct.pack("<B3xQQQ", 0, len(text), NONE, self.put(text)))
            half = max(1, len(names) // 2)
            symbols = lambda part: self.put(b"SNOD" + struct.pack("<BxH", 1, len(part)) + b"".join(struct.pack("<QQII16x", p, self.named[n], 0, 0) for n, p in part))
            pairs = list(zip(names, places))
            nodes = [symbols(p) for p in (pairs[:half], pairs[half:]) if p]
            tree = self.put(b"TREE" + struct.pack("<BBHQQ", 0, 0, len(nodes), NONE, NONE) + b"".join(struct.pack("<QQ", 0, n) for n in nodes) + struct.pack("<Q", 0))
            root = self.header([(17, struct.pack("<QQ", tree, heap))])
            head = b"\x89HDF\r\n\x1a\n" + struct.pack("<8BHHI", 0, 0, 0, 0, 0, 8, 8, 0, 4, 16, 0) + struct.pack("<QQQQ", 0, NONE, len(self.out), NONE) + struct.pack("<QQII16x", 0, root, 0, 0)
        self.out[: len(head)] = head
        path.write_bytes(bytes(self.out))
