"""Caption files as a data source: in batches, and in a stream that goes on from its checkpoint."""

from __future__ import annotations

import pytest

from korvane.operators.transcript import cues
from korvane.sources.caption_source import CaptionSource, caption_stream


def write(folder, *names):
    for name in names:
        (folder / f"{name}.vtt").write_text(f"WEBVTT\n\n00:01.000 --> 00:02.000\nAnn: {name}\n\n00:02.000 --> 00:03.000\nmore\n")


@pytest.fixture
def source(spark):
    spark.dataSource.register(CaptionSource)
    return spark


def test_files_are_partitions(source, tmp_path):
    write(tmp_path, "b", "a", "c")
    (tmp_path / "notes.txt").write_text("x")
    rows = source.read.format("webvtt").load(str(tmp_path))
    assert rows.rdd.getNumPartitions() == 3
    assert {(r.video_id, r.speaker, r.text) for r in cues(rows).collect()} == {(v, *x) for v in "abc" for x in (("Ann", v), (None, "more"))}
    first = source.read.format("webvtt").option("first", 2).load(f"file://{tmp_path}")
    assert {r.video_id for r in first.collect()} == {"a", "b"}


@pytest.mark.parametrize(("text", "error"), [("", "empty"), (" \n", "empty"), ("captions", "not WebVTT"), (None, "no WebVTT files")])
def test_what_is_no_caption_file_is_an_error(source, tmp_path, text, error):
    if text is not None:
        write(tmp_path, "a")
        (tmp_path / "b.vtt").write_text(text)
    with pytest.raises(Exception, match=error):
        source.read.format("webvtt").load(str(tmp_path)).collect()


def test_a_stream_goes_on_behind_its_last_path(source, tmp_path):
    folder, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    folder.mkdir()

    def drain():
        query = caption_stream(source, str(folder), 2).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        return sorted(r.video_id for r in source.read.parquet(out).collect())

    write(folder, "v1", "v2", "v3")
    assert drain() == ["v1"] * 2 + ["v2"] * 2 + ["v3"] * 2
    write(folder, "v4")
    (folder / "v1.vtt").write_text("broken since")  # isn't read again
    assert drain() == [f"v{i}" for i in range(1, 5) for _ in range(2)]
    assert drain() == [f"v{i}" for i in range(1, 5) for _ in range(2)]
