import os
import shutil
import threading

from marginalia.sinks import atomic, publish


def rows(spark, *ids):
    return spark.createDataFrame([(i, f"row {i}") for i in ids], "id long, text string")


def ids(spark, path):
    return sorted(r["id"] for r in spark.read.parquet(path).collect())


def test_publish_writes_once(spark, tmp_path):
    at = f"{tmp_path}/out"
    assert atomic.state(spark, at) == "absent"
    assert atomic.publish(rows(spark, 1, 2), at) == "written" and atomic.state(spark, at) == "finished"
    assert atomic.publish(rows(spark, 3), at) == "refused" and ids(spark, at) == [1, 2]
    assert [n for n in os.listdir(tmp_path)] == ["out"]


def test_partitions_and_a_lost_file(spark, tmp_path):
    at = f"{tmp_path}/out"
    assert atomic.publish(rows(spark, 1, 2, 3), at, ["id"]) == "written" and atomic.state(spark, at) == "finished"
    shutil.rmtree(f"{at}/id=2")
    assert atomic.state(spark, at) == "broken" and atomic.publish(rows(spark, 9), at) == "broken"
    assert publish.apply_once(rows(spark, 1, 2, 3), at, ["id"]) == "written" and ids(spark, at) == [1, 2, 3]


def test_a_crash_before_the_rename_is_no_obstacle(spark, tmp_path):
    at = f"{tmp_path}/out"
    left = atomic.stage(rows(spark, 7), at)
    assert atomic.state(spark, at) == "absent" and len(atomic.stages(spark, at)) == 1
    assert publish.apply_once(rows(spark, 1), at, ["id"]) == "written" and ids(spark, at) == [1]
    assert os.path.isdir(left)


def test_half_written_folders(spark, tmp_path):
    """Only _temporary, as a crashed writer leaves it; data without a manifest; a manifest that lies."""
    for k, spoil in enumerate(("_temporary/0", "part.parquet", atomic.MANIFEST)):
        at = f"{tmp_path}/out{k}"
        os.makedirs(f"{at}/{spoil}" if k == 0 else at)
        if k:
            with open(f"{at}/{spoil}", "w") as f:
                f.write('{"files": {"part-0": 5}}')
        assert atomic.state(spark, at) == "broken" and publish.write_new(rows(spark, 1), at) == "broken"
        assert publish.apply_once(rows(spark, 1), at, ["id"]) == "written"
        assert publish.apply_once(rows(spark, 1), at, ["id"]) == "reused" and publish.apply_once(rows(spark, 2), at, ["id"]) == "conflict"


def test_of_writers_at_once_one_writes(spark, tmp_path):
    at, said = f"{tmp_path}/out", []
    writers = [threading.Thread(target=lambda k=k: said.append((atomic.publish(rows(spark, *range(k + 1)), at), k))) for k in range(4)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert sorted(s for s, _ in said) == ["refused"] * 3 + ["written"]
    winner = next(k for s, k in said if s == "written")
    assert ids(spark, at) == list(range(winner + 1)) and os.listdir(tmp_path) == ["out"]
