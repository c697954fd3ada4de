
import os

import pytest

from curatio.operators.parse import parse_outputs
from curatio.session import local_path, scratch_path
from curatio.sinks.files import write_output_shards
from curatio.sources.files import PART_SHARD_RE, read_output_arrays, shard_positions
from curatio.streaming.outputs import parsed_output_stream, positioned_outputs, run_available, shard_offset_stream


def test_two_incremental_runs_equal_one_batch(spark):
    outs = [("train", i, f"R{i} So the answer is (a) w{i}") for i in range(25)]
    df = spark.createDataFrame(outs, "split string, row_pos long, output string")
    src, sink, ckpt = (scratch_path(spark, n) for n in ("s-src", "s-sink", "s-ckpt"))
    write_output_shards(df.where("row_pos < 10"), f"{src}/a", 10)
    run_available(parsed_output_stream(spark, f"{src}/*/split=*/shard=*/*.txt", "cqa", "gpt"), sink, ckpt)
    first = spark.read.parquet(sink).count()
    write_output_shards(df.where("row_pos >= 10"), f"{src}/b", 10)
    run_available(parsed_output_stream(spark, f"{src}/*/split=*/shard=*/*.txt", "cqa", "gpt"), sink, ckpt)
    got = sorted((r.row_pos, r.rationale, r.label) for r in shard_positions(spark.read.parquet(sink)).collect())
    batch = sorted((r.row_pos, r.rationale, r.label) for r in parse_outputs(df, "cqa", "gpt").collect())
    assert first == 10 and got == batch


def test_a_short_middle_shard_gives_the_batch_positions(spark):
    """Shards of 10, 4 and 10 outputs: the stream's rows equal the batch source's."""
    src, sink, ckpt = (scratch_path(spark, n) for n in ("q-src", "q-sink", "q-ckpt"))
    for part, (shard, n) in enumerate([(2, 10), (0, 10), (1, 4)]):
        rows = [("train", shard * 10 + i, f"R{shard}-{i} So the answer is (a) w{i}") for i in range(n)]
        write_output_shards(spark.createDataFrame(rows, "split string, row_pos long, output string"), f"{src}/{part}", 10)
        run_available(parsed_output_stream(spark, f"{src}/*/split=*/shard=*/*.txt", "cqa", "gpt"), sink, ckpt)
    got = sorted((r.row_pos, r.rationale, r.label) for r in shard_positions(spark.read.parquet(sink)).collect())
    batch = parse_outputs(read_output_arrays(spark, f"{src}/*/split=*/shard=*/*.txt", PART_SHARD_RE), "cqa", "gpt")
    assert got == sorted((r.row_pos, r.rationale, r.label) for r in batch.collect())
    assert [p for p, _, _ in got] == list(range(24)) and got[10][1].startswith("R1-0")


def _glob(src):
    return f"{src}/*/split=*/shard=*/*.txt"


def test_positions_in_the_stream_whatever_the_order_of_arrival(spark):
    """Three runs, shards out of order and of different sizes; a killed run that starts again adds nothing twice."""
    src, rows, offsets, c1, c2 = (scratch_path(spark, f"p-{n}") for n in ("src", "rows", "offsets", "c1", "c2"))
    sizes = {0: 10, 1: 4, 2: 10, 3: 1, 4: 7}
    waiting = []
    for part, shards in enumerate([(4, 1), (2, 0), (3,)]):
        data = [(s, i * 10 + k, f"R{s}-{i} So the answer is (a) w{i}") for s in ("train", "test") for i in shards for k in range(sizes[i])]
        write_output_shards(spark.createDataFrame(data, "split string, row_pos long, output string"), f"{src}/{part}", 10)
        run_available(parsed_output_stream(spark, _glob(src), "cqa", "gpt"), rows, c1)
        if part == 1:       # killed before its commit: the batch's commit entry is gone, and the run starts again
            run_available(shard_offset_stream(spark, _glob(src)), offsets, c2)
            commits = sorted(p for p in os.listdir(local_path(f"{c2}/commits")) if p.isdigit())
            for name in (commits[-1], f".{commits[-1]}.crc"):
                if os.path.exists(local_path(f"{c2}/commits/{name}")):
                    os.remove(local_path(f"{c2}/commits/{name}"))
        run_available(shard_offset_stream(spark, _glob(src)), offsets, c2)
        waiting.append(sorted({r.shard for r in spark.read.parquet(offsets).collect()}) if os.path.exists(local_path(offsets)) and
                       any(f.startswith("split=") for f in os.listdir(local_path(offsets))) else [])
    assert waiting == [[], [0, 1, 2], [0, 1, 2, 3, 4]]
    got = sorted((r.split, r.row_pos, r.rationale, r.label) for r in positioned_outputs(spark, rows, offsets).collect())
    batch = parse_outputs(read_output_arrays(spark, _glob(src), PART_SHARD_RE), "cqa", "gpt")
    assert got == sorted((r.split, r.row_pos, r.rationale, r.label) for r in batch.collect()) and len(got) == 64


def test_a_damaged_shard_stops_the_stream_until_it_is_mended(spark):
    src, sink, ckpt = (scratch_path(spark, n) for n in ("d-src", "d-sink", "d-ckpt"))
    at = local_path(f"{src}/a/split=train/shard=0")
    os.makedirs(at)
    with open(f"{at}/part.txt", "w") as f:
        f.write('["R So the answer is (a) w", "cut')
    with pytest.raises(Exception, match="damaged shard"):
        run_available(parsed_output_stream(spark, _glob(src), "cqa", "gpt"), sink, ckpt)
    listed, ckpt2 = scratch_path(spark, "d-sink"), scratch_path(spark, "d-ckpt")
    run_available(parsed_output_stream(spark, _glob(src), "cqa", "gpt", on_damaged="quarantine"), listed, ckpt2)
    assert [(r.shard_idx, r.damaged) for r in spark.read.parquet(listed).collect()] == [(None, "not a JSON array")]
    with open(f"{at}/part.txt", "w") as f:
        f.write('["R So the answer is (a) w"]')
    run_available(parsed_output_stream(spark, _glob(src), "cqa", "gpt"), sink, ckpt)
    assert [r.rationale for r in spark.read.parquet(sink).collect()] == ["R"]
