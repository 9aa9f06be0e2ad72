"""Requests to a model: pace, attempts, the day's limit, what is kept when a task fails."""

import json
import os

import pytest

from termsieve.operators import model as M
from termsieve.plans import report

F = M.F
SETTINGS = M.Settings("m", "verdict string")


class Clock:
    def __init__(self):
        self.now, self.slept = 100.0, []

    def __call__(self):
        return self.now

    def sleep(self, seconds):
        if seconds:
            self.slept.append(round(seconds, 3))
        self.now += seconds


def lane(answers, budget=100, apart=2.0):
    clock, asked = Clock(), []

    def model(request, settings):
        asked.append((clock.now, request["key"], settings))
        clock.now += 0.25
        out = answers[min(len(asked), len(answers)) - 1]
        if isinstance(out, Exception):
            raise out
        return out

    return M.Lane(model, SETTINGS, apart, budget, clock, clock.sleep), clock, asked


def request(k=1):
    return {"key": f"k{k}", "stage": "judge"}


def test_a_lane_keeps_its_pace_and_counts_thinking():
    one, clock, asked = lane([M.Said("{}", 10, 5, 7)])
    rows = [r for k in range(3) for r in one.attempts(request(k))]
    assert [b[0] - a[0] for a, b in zip(asked, asked[1:])] == [2.0, 2.0] and asked[0][2].temperature == 0 and not asked[0][2].think
    assert {(r["input_tokens"], r["output_tokens"], r["latency_ms"], r["ok"], r["attempt"]) for r in rows} == {(10, 12, 250, True, 1)}


@pytest.mark.parametrize(
    ("errors", "attempts", "gone"),
    [
        ([M.Refused("busy", 503), M.Refused("slow down", 429)], 3, False),
        ([M.Refused("busy", 500)] * 9, 5, False),
        ([M.Refused("no such model", 404)] * 9, 1, False),
        ([M.Refused("bad key", 403, key=True)] * 9, 1, True),
        ([M.Refused("no route")] * 9, 5, True),
    ],
)
def test_what_is_tried_again(errors, attempts, gone):
    one, clock, asked = lane([*errors, M.Said("{}")], apart=0.0)
    rows = list(one.attempts(request()))
    assert len(rows) == len(asked) == attempts and rows[-1]["gone"] == gone and rows[-1]["ok"] == (len(errors) < attempts)
    assert clock.slept == list(M.DELAYS[: attempts - 1]) and all(r["error"] for r in rows if not r["ok"])


def test_a_lane_stops_at_its_budget():
    one, _, asked = lane([M.Refused("busy", 503)], budget=3, apart=0.0)
    assert len(list(one.attempts(request()))) == 3 and list(one.attempts(request(2))) == [] and len(asked) == 3


def requests(spark, n):
    return spark.createDataFrame([(f"k{k:03d}", "judge", f"text {k}") for k in range(n)], "key string, stage string, text string")


def noting(place, answer='{"verdict": "unsure"}', fails=None, say=None):
    """A model that notes who asked in a file all tasks can reach."""

    def model(request, settings):
        with open(place, "a") as f:
            f.write(request["key"] + "\n")
        if fails:
            fails(request)
        return M.Said(say(request) if say else answer, 3, 2, 1)

    return model


def asked_of(place):
    return open(place).read().split() if os.path.exists(place) else []


def fast(seconds):
    pass


def go(spark, n, model, path, **more):
    return M.ask_all(requests(spark, n), model, SETTINGS, path, per_minute=60_000, sleep=fast, **{"lanes": 3, "per_round": 4} | more)


def test_answers_are_kept_and_not_asked_again(spark, tmp_path):
    place, path = str(tmp_path / "asked"), str(tmp_path / "log")
    assert go(spark, 20, noting(place), path) is None and sorted(asked_of(place)) == [f"k{k:03d}" for k in range(20)]
    log = M.Log(spark, path)
    assert log.answers("verdict string").select("key", "answer.verdict").distinct().count() == 20
    calls = log.calls()
    day = report.usage(calls).collect()
    assert sum(r.calls for r in day) == 20 and sum(r.output_tokens for r in day) == 60 and calls.where("NOT ok").count() == 0
    assert go(spark, 26, noting(place), path) is None and len(asked_of(place)) == 26 == len(set(asked_of(place)))


def test_the_day_has_a_limit(spark, tmp_path):
    place, path = str(tmp_path / "asked"), str(tmp_path / "log")
    assert go(spark, 30, noting(place), path, per_day=12, used_today=5) == M.LIMIT and len(asked_of(place)) == 7
    assert go(spark, 30, noting(place), path, per_day=12, used_today=5) == M.LIMIT and len(asked_of(place)) == 7

    def busy(request):
        raise M.Refused("busy", 503)

    path = str(tmp_path / "other")
    assert go(spark, 30, noting(place + "2", fails=busy), path, per_day=13) == M.LIMIT
    assert len(asked_of(place + "2")) == 13 == M.Log(spark, path).calls().where("NOT ok").count()


def test_a_step_ends_when_the_service_is_gone(spark, tmp_path):
    place, path = str(tmp_path / "asked"), str(tmp_path / "log")

    def gone(request):
        if request["key"] >= "k010":
            raise M.Refused("key refused", 401, key=True)

    assert go(spark, 40, noting(place, fails=gone), path) == M.GONE and len(asked_of(place)) < 20
    done = M.Log(spark, path).answers("verdict string").count()
    assert done == 10 and go(spark, 40, noting(place), path) is None
    assert all(asked_of(place).count(f"k{k:03d}") == 1 for k in range(10))


def test_a_lost_task_asks_its_own_requests_only(spark, tmp_path):
    """The job of a round fails in one task: what rounds before it stored stays, and is not asked again."""
    place, path, mark = str(tmp_path / "asked"), str(tmp_path / "log"), str(tmp_path / "failed")

    def dies(request):
        if request["key"] == "k017" and not os.path.exists(mark):
            open(mark, "w").close()
            raise RuntimeError("the worker is lost")

    with pytest.raises(Exception, match="worker is lost"):
        go(spark, 24, noting(place, fails=dies), path)
    kept = {r.key for r in M.Log(spark, path).rows().collect()}
    assert kept == {f"k{k:03d}" for k in range(12)}
    assert go(spark, 24, noting(place, fails=dies), path) is None
    asked = asked_of(place)
    assert all(asked.count(k) == 1 for k in kept) and set(asked) == {f"k{k:03d}" for k in range(24)}
    assert M.Log(spark, path).answers("verdict string").count() == 24


def test_answers_of_another_form_are_told_apart(spark, tmp_path):
    said = ['{"verdict": "unsure", "more": 1}', "no json", "[1]", '{"verdict": 3}', "{}", '{"verdict": null}']
    path = str(tmp_path / "log")
    assert go(spark, 6, noting(str(tmp_path / "asked"), say=lambda r: said[int(r["key"][1:])]), path) is None
    log = M.Log(spark, path)
    assert [(r.key, r.answer.verdict) for r in log.answers("verdict string").collect()] == [("k000", "unsure")]
    assert {(r.key, r.answer) for r in log.bad_answers("verdict string").collect()} == {(f"k{k:03d}", t) for k, t in enumerate(said) if k}


def test_lines_of_images(spark, tmp_path):
    lines = ["  two \n words ", "", None, *map(str, range(300))]
    path = str(tmp_path / "log")
    assert go(spark, 1, noting(str(tmp_path / "asked"), json.dumps({"lines": lines})), path) is None
    got = [r.text for r in M.lines_of_images(M.Log(spark, path)).orderBy("pos").collect()]
    assert got[:3] == ["two words", "0", "1"] and len(got) == M.MOST_LINES


def test_a_failed_step_leaves_the_run():
    assert M.paused(lambda: {"review": 1}) == {"enabled": True, "review": 1}
    assert M.paused(lambda: 1 / 0) == {"enabled": True, "error": "ZeroDivisionError: division by zero"}
