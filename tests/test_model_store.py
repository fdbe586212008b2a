"""Stored models: versions, aliases, broken and competing writers."""

import pytest

from offerrank.operators.learn import OfferModel
from offerrank.plans.model_store import AliasMoved, ModelStore
from offerrank.sources import files


@pytest.fixture(scope="module")
def model(pipeline):
    return pipeline.train(rounds=1, depth=1)


def test_save_alias_and_load(spark, pipeline, model, tmp_path):
    store = ModelStore(spark, str(tmp_path / "models"))
    assert store.versions() == [] and store.version_of("champion") is None and store.table().count() == 0
    with pytest.raises(KeyError):
        store.load()
    assert store.save(model, {"rmse": 2.0, "mae": 1.0, "r2": 0.5}) == 1
    assert store.save(model) == 2
    store.set_alias("champion", 1)
    store.set_alias("challenger", 2)
    assert sorted((r.version, r.alias, r.rmse) for r in store.table().collect()) == [(1, "champion", 2.0), (2, "challenger", None)]
    again = store.load("champion")
    assert again.offer_ids == model.offer_ids
    wanted = model.predict(pipeline.features, ["member_id"])
    assert again.predict(pipeline.features, ["member_id"]).exceptAll(wanted).isEmpty()
    store.set_alias("challenger", None)
    assert store.version_of("challenger") is None
    with pytest.raises(KeyError):
        store.set_alias("champion", 9)


def test_a_writer_that_dies_leaves_the_old_model(spark, model, tmp_path, monkeypatch):
    store = ModelStore(spark, str(tmp_path))
    store.set_alias("champion", store.save(model))
    whole = OfferModel.save

    def dies_half_way(self, path):
        whole(self, path)
        raise OSError("lost")

    monkeypatch.setattr(OfferModel, "save", dies_half_way)
    with pytest.raises(OSError):
        store.save(model)
    monkeypatch.undo()
    assert store.versions() == [1] and store.version_of("champion") == 1
    # died after the version was stored, before the alias moved
    monkeypatch.setattr(files, "claim", lambda spark, source, target, _claim=files.claim: "/aliases/" not in target and _claim(spark, source, target) or _die(target))
    with pytest.raises(OSError):
        store.set_alias("champion", store.save(model))
    monkeypatch.undo()
    assert store.versions() == [1, 2] and store.version_of("champion") == 1
    assert store.load().offer_ids == model.offer_ids
    assert store.save(model) == 3


def _die(target):
    raise OSError(target)


def test_two_writers_get_two_versions_and_one_moves_the_alias(spark, model, tmp_path, monkeypatch):
    one, two = ModelStore(spark, str(tmp_path)), ModelStore(spark, str(tmp_path))
    one.set_alias("champion", one.save(model))
    monkeypatch.setattr(one, "versions", lambda: [])  # looked before the other one wrote
    assert two.save(model) == 2 and one.save(model) == 3
    two.set_alias("champion", 2, expected=1)
    with pytest.raises(AliasMoved):
        one.set_alias("champion", 3, expected=1)
    assert one.version_of("champion") == 2
    # the other writer moves it between the comparison and the rename
    real = one.version_of

    def overtaken(alias):
        found = real(alias)
        if found == 2:
            two.set_alias(alias, 1)
        return found

    monkeypatch.setattr(one, "version_of", overtaken)
    with pytest.raises(AliasMoved):
        one.set_alias("champion", 3, expected=2)
    assert real("champion") == 1


def test_retraining_stores_and_promotes(spark, pipeline, tmp_path):
    store = ModelStore(spark, str(tmp_path))
    feedback = pipeline.tables["feedback"]
    assert store.retrain(pipeline, feedback.limit(3)) is None and store.versions() == []
    _, first = store.retrain(pipeline, feedback, rounds=1, depth=1)
    assert (first, store.version_of("champion"), store.version_of("challenger")) == (1, 1, None)
    _, second = store.retrain(pipeline, feedback, rounds=1, depth=1)  # the same model again: not better
    assert (second, store.version_of("champion"), store.version_of("challenger")) == (2, 1, 2)
    assert {r.version: r.alias for r in store.table().collect()} == {1: "champion", 2: "challenger"}
