"""The driver gives back what finished steps held."""

from pkgloom import engine


def test_steps_are_released_as_they_go(spark, monkeypatch):
    released = []
    monkeypatch.setattr(engine, "release", released.append)
    for k in range(24):
        engine.cut(spark.range(k + 1))
    assert len(released) >= 2 and set(released) == {spark}


def test_stored_frames_outlive_a_release(spark):
    kept = [engine.cut(spark.range(k + 1)) for k in range(8)]
    engine.release(spark)
    assert [df.count() for df in kept] == list(range(1, 9))


def test_release_without_the_command(spark, monkeypatch):
    monkeypatch.setattr(engine, "TRIM", "nothing")
    engine.release(spark)
    monkeypatch.setattr(engine, "COMMANDS", "nowhere:type=Nothing")
    engine.release(spark)
