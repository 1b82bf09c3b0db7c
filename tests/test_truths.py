"""Archives and annotations that are written here and read back; matches by aligned error against plain NumPy."""

import json

import numpy as np
import pytest

from gazeloom.operators import folds, metrics
from gazeloom.sources import truths
from gazeloom.sources.probe import Ranges


def turned(points, rng, noise=0.0):
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    q *= np.sign(np.linalg.det(q))
    return rng.uniform(0.5, 2) * points @ q + rng.normal(size=3) * 50 + rng.normal(size=points.shape) * noise


@pytest.mark.parametrize("save", [np.savez, np.savez_compressed])
def test_archives_round_trip(spark, tmp_path, save):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(2, 250, 21, 3))
    names, prov = np.array([f"joint {k}" for k in range(21)]), np.array([["seen", "guessed"][k % 2] for k in range(21)])
    save(tmp_path / "first.npz", pred=a, gt=b, joint_names=names, provenance=prov)
    save(tmp_path / "second.npz", pred=a[:40].astype(np.float32), gt=b[:40].astype(np.float32), provenance=np.array([[f"{s}" for _ in range(21)] for s in range(40)]))
    df = truths.pairs(spark, f"file://{tmp_path}", rows=60)
    assert df.rdd.getNumPartitions() == 6
    got = {(r.dataset, r["sample"]): r for r in df.collect()}
    assert len(got) == 290
    for k in (0, 59, 60, 249):
        r = got["first", k]
        assert np.array_equal(np.array(r.predicted), a[k]) and np.array_equal(np.array(r.truth), b[k]) and r.joint_names == names.tolist() and r.provenance == prov.tolist()
    r = got["second", 39]
    assert np.array_equal(np.array(r.predicted), a[39].astype(np.float32)) and r.joint_names[:2] == ["j0", "j1"] and r.provenance == ["39"] * 21


def test_only_a_slice_of_a_stored_array_is_read(tmp_path):
    a = np.arange(200_000 * 63, dtype=float).reshape(200_000, 21, 3)
    np.savez(tmp_path / "a.npz", pred=a, gt=a)
    r = Ranges(f"file://{tmp_path}/a.npz")
    found = truths.array(r, truths.members(r), "gt")
    assert np.array_equal(found.rows(r, 150_000, 150_010), a[150_000:150_010])
    assert r.read < 200_000 < 100_000_000 < r.length


@pytest.mark.parametrize(("arrays", "said"), [({"pred": np.zeros((2, 21, 3))}, "must be there"), ({"pred": np.zeros((2, 21, 3)), "gt": np.zeros((3, 21, 3))}, "of one shape"), ({"pred": np.array([None, 1]), "gt": np.array([None, 1])}, "objects"), ({"pred": np.asfortranarray(np.ones((2, 3, 3))), "gt": np.ones((2, 3, 3))}, "order of rows")])
def test_odd_archives_are_refused(spark, tmp_path, arrays, said):
    np.savez(tmp_path / "a.npz", **arrays)
    with pytest.raises(Exception, match=said):
        truths.pairs(spark, f"file://{tmp_path}/a.npz").collect()


def test_files_that_are_no_archives(tmp_path):
    (tmp_path / "a.npz").write_bytes(b"x" * 100)
    with pytest.raises(ValueError, match="not an archive"):
        truths.members(Ranges(f"file://{tmp_path}/a.npz"))


def records(rng, unit):
    """Annotations of two sequences: a whole frame, one whose left hand misses a joint, and one that is cut short."""
    world = rng.normal(size=(42, 3)) * 0.2 * unit
    valid = [True] * 42
    some = [*valid]
    some[30] = False
    return world, {"annotations": {"s1": {"000005": {"world_coord": world.tolist(), "joint_valid": valid}, "000006": {"world_coord": world.tolist(), "joint_valid": [int(v) for v in some]}}, "s2": {"000001": {"world_coord": world[:25].tolist(), "joint_valid": valid[:25]}}}}


@pytest.mark.parametrize("unit", [1.0, 1000.0])
def test_annotations_with_validity(spark, tmp_path, unit):
    world, document = records(np.random.default_rng(2), unit)
    (tmp_path / "a.json").write_text(json.dumps(document, indent=1))
    got = {(r.sequence, r.frame, r.truth_id): r for r in truths.hand_annotations(spark, str(tmp_path / "a.json")).collect()}
    assert {k: r.valid for k, r in got.items()} == {("s1", 5, "R"): True, ("s1", 5, "L"): True, ("s1", 6, "R"): True, ("s1", 6, "L"): False, ("s2", 1, "R"): True, ("s2", 1, "L"): False}
    right = np.array(got["s1", 5, "R"].points)
    assert np.allclose(right, world[list(truths.RIGHT_HAND)] * 1000 / unit) and got["s2", 1, "L"].points is None
    assert np.allclose(np.array(got["s1", 5, "L"].points)[0], world[41] * 1000 / unit)  # the wrist
    assert sum(got["s1", 6, "L"].joint_valid) == 20


@pytest.mark.parametrize("listed", [True, False])
def test_truths_of_images_at_hand(spark, tmp_path, listed):
    _, document = records(np.random.default_rng(3), 1000.0)
    (tmp_path / "a.json").write_text(json.dumps(document))
    images = [{"seq_name": s, "frame_idx": f, "file_name": f"{s}/{c}/{f}.jpg", "id": f} for s, f in (("s1", 5), ("s1", 6), ("s2", 1), ("s3", 9)) for c in ("cam1", "cam2")]
    (tmp_path / "b.json").write_text(json.dumps({"images": images if listed else {str(k): x for k, x in enumerate(images)}}))
    there = spark.createDataFrame([("s1/cam1/5.jpg",), ("s1/cam2/6.jpg",), ("other.jpg",)], "file_name string")
    got = truths.hand_truths(spark, str(tmp_path / "a.json"), str(tmp_path / "b.json"), there)
    assert sorted((r.image, r.file_name, r.truth_id) for r in got.collect()) == [("s1/000005", "s1/cam1/5.jpg", "L"), ("s1/000005", "s1/cam1/5.jpg", "R"), ("s1/000006", "s1/cam2/6.jpg", "R")]


def plain_errors(p, g):
    a, b = p - p.mean(0), g - g.mean(0)
    u, s, vt = np.linalg.svd(a.T @ b)
    d = np.diag([1, 1, np.sign(np.linalg.det(u @ vt))])
    return np.linalg.norm((s @ np.diag(d)) / (a**2).sum() * a @ (u @ d @ vt) - b, axis=1)


def test_stacked_alignment_equals_one_by_one(spark):
    rng = np.random.default_rng(4)
    rows = [(k, rng.normal(size=(n, 3)).tolist(), rng.normal(size=(n, 3)).tolist()) for k, n in enumerate([21] * 30 + [17] * 10 + [3, 4])]
    rows += [(100, None, rows[0][1]), (101, [], []), (102, rows[0][1], rows[30][1]), (103, [[1.0, 2.0]] * 21, rows[0][1]), (104, [[float("nan"), 0.0, 1.0]] + rows[0][1][1:], rows[0][1]), (105, [None] + rows[0][1][1:], rows[0][1]), (106, rows[5][1], rows[5][2])]
    df = spark.createDataFrame(rows, "id int, p array<array<double>>, q array<array<double>>").repartition(2)
    got = {r.id: r.pa_errors for r in folds.aligned_errors(df, "p", "q").collect()}
    assert all(got[k] is None for k in (100, 101, 102, 103, 104, 105)) and got[106] == got[5]
    for k, p, q in rows[:42]:
        assert got[k] == pytest.approx(plain_errors(np.array(p), np.array(q)).tolist(), abs=1e-9)
    assert folds.aligned_errors(df.where("false"), "p", "q").count() == 0


def test_matches_by_aligned_error(spark, tmp_path):
    """A hand that is turned and scaled is nearest to its own truth, though the other's root-aligned error is less."""
    rng = np.random.default_rng(5)
    hands = rng.normal(size=(12, 2, 21, 3)) * 40
    annotations = {"annotations": {"s": {f"{k:06d}": {"world_coord": np.concatenate([h[0][np.argsort(truths.RIGHT_HAND)], h[1][np.argsort(truths.RIGHT_HAND)]]).tolist(), "joint_valid": [True] * 42} for k, h in enumerate(hands)}}}
    (tmp_path / "a.json").write_text(json.dumps(annotations))
    found = [(f"s/{k:06d}", 2 * k + side, turned(h[side], rng, 1.0).tolist()) for k, h in enumerate(hands) for side in (0, 1)]
    predicted = spark.createDataFrame([*found, ("s/none", 99, found[0][2])], "image string, prediction_id int, points array<array<double>>")
    matches = metrics.best_aligned_match(predicted, truths.hand_truths(spark, str(tmp_path / "a.json")), "image")
    got = {r.prediction_id: r for r in matches.collect()}
    assert {k: r.truth_id for k, r in got.items()} == {2 * k + side: "RL"[side] for k in range(12) for side in (0, 1)}
    for image, p, points in found:
        own = plain_errors(np.array(points), hands[p // 2][p % 2])
        assert got[p].pa_errors == pytest.approx(own.tolist()) and got[p].pa_error == pytest.approx(own.mean()) and got[p].root_error > got[p].pa_error
    total = {r.joint: r for r in truths.evaluation(matches, [f"j{k}" for k in range(21)]).collect()}
    assert total[None].n == 24 * 21 and total[None].pa_mpjpe == pytest.approx(np.mean([r.pa_error for r in got.values()])) and len(total) == 22
