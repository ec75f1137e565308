import hashlib
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lamina.llm import files, media
from lamina.llm.common import scratch_path

from .conftest import SF


def expected(docs):
    out = []
    for i, text in docs:
        raw = (text or "").encode()
        size = max(1, -(-len(raw) // 576)) * 576
        payload = raw.ljust(size, b"\xff")
        out.append((i, len(raw), size, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r)[:5] for r in df.collect()), key=str)


@settings(max_examples=50, deadline=None)
@given(st.binary(max_size=2000).map(lambda b: b.replace(b"\xff", b"")))
def test_png_round_trip(raw):
    payload = media.payload_of(raw)
    assert len(payload) % 576 == 0 and payload.rstrip(b"\xff") == raw
    assert media.decode_png(media.encode_png(payload)) == payload


def test_whole_table(spark, sample):
    out = media.op1_media(spark, SF)
    assert found(out) == expected(sample)
    by_payload = {}
    for r in out.collect():
        assert by_payload.setdefault(r["payload_sha256"], (r["media_bytes"], r["media_sha256"], r["feature"])) == (r["media_bytes"], r["media_sha256"], r["feature"])


def test_odd_rows_and_byte_ranges(spark, odd, odd_texts, empty):
    path = scratch_path(spark, "test")
    media.write_media(odd, path)
    for split in (1, 3000, 1 << 24):  # ranges smaller than a member lose and repeat none
        assert found(media.media_features(media.read_media(spark, path, splitBytes=split))) == expected(odd_texts)
    path = scratch_path(spark, "test")
    media.write_media(empty, path)
    assert media.read_media(spark, path).count() == 0


def test_members_are_tried_anew_alone(tmp_path):
    class Flaky:
        opened = 0

        def open_input_file(self, path):
            Flaky.opened += 1
            if Flaky.opened < 3:
                raise OSError("the store is away")
            return files.open_store(str(tmp_path))[0].open_input_file(path)

    import tarfile

    png = media.encode_png(media.payload_of(b"kept"))
    info = tarfile.TarInfo("000000000/5.png")
    info.size = len(png)
    head = info.tobuf(tarfile.USTAR_FORMAT)
    (tmp_path / "a.data").write_bytes(bytes(512) + head + png)
    reader = media._ArchiveReader({"path": str(tmp_path)})
    name, body = reader._member(Flaky(), str(tmp_path / "a.data"), 512, len(head) + len(png))
    assert (name, body, Flaky.opened) == ("000000000/5.png", png, 3)
    Flaky.opened = -99
    with pytest.raises(OSError):
        reader._member(Flaky(), str(tmp_path / "a.data"), 512, len(head) + len(png))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=60), st.integers(-2, 45), st.integers(0, 20), st.integers(1, 9))
def test_slices_of_a_sorted_index(keys, start, length, page):
    import io
    import struct

    class Held(io.BytesIO):
        read_bytes = 0

        def size(self):
            return len(self.getvalue())

        def read_at(self, n, at):
            Held.read_bytes += n
            return self.getvalue()[at : at + n]

    keys = sorted(keys)
    held = Held(b"".join(struct.pack("<qq", k, i) for i, k in enumerate(keys)))
    got = files.records_between(held, start, start + length, page=page).tolist()
    assert got == [[k, i] for i, k in enumerate(keys) if start <= k < start + length]
    with pytest.raises(OSError):
        files.integers(held, 2 * len(keys), 1)


def test_a_range_reads_its_part_of_the_index(spark, tmp_path, monkeypatch):
    import numpy as np

    (tmp_path / "i").write_bytes(np.column_stack([np.arange(200_000) * 1536, np.full(200_000, 1500)]).astype("<i8").tobytes())
    read = []
    whole = files.integers
    monkeypatch.setattr(files, "integers", lambda f, at, n: read.append(n) or whole(f, at, n))
    with files.open_store(str(tmp_path))[0].open_input_file(str(tmp_path / "i")) as f:
        assert len(files.records_between(f, 16 << 20, 32 << 20)) == -(-(32 << 20) // 1536) - -(-(16 << 20) // 1536)
    assert sum(read) < 2 * 4 * 4096 + 100
