"""Starts and refusals of a provider over all tasks of a run."""

import time
import urllib.error
import uuid

import pytest
from biblion.operators import classify, enrich, pacing


def notes(folder):
    def noted(*words):
        """A line in a file of its own, so that processes do not write into each other's."""
        (folder / uuid.uuid4().hex).write_text(" ".join(map(str, words)))

    return noted


def lines(folder):
    return sorted(tuple(f.read_text().split()) for f in folder.iterdir())


@pytest.mark.parametrize("parallel", [1, 4])
def test_starts_are_apart_over_all_tasks(spark, tmp_path, parallel):
    noted = notes(tmp_path)

    def post(url, headers, body, before):
        for _ in range(2):  # an attempt and a retry
            before()
            noted(f"{time.time():.6f}")
            time.sleep(0.03)
        return "{}"

    rows = spark.createDataFrame([(str(i), f"text {i}") for i in range(16)], "key string, t string")
    client = enrich.classifier_client(post, "https://c.org", "m", spaced=lambda: pacing.gate("classifier", 0.1))
    with pacing.leased(spark, {"classifier": 0.1}):
        with pacing.leased(spark, {"classifier": 99.0}):  # the outer block counts
            got = classify.call_rows(rows, client, "t", parallel).collect()
    starts = [float(t) for (t,) in lines(tmp_path)]
    assert len(got) == 16 and len(starts) == 32
    assert min(b - a for a, b in zip(starts, starts[1:], strict=False)) >= 0.1 - 0.002
    assert spark.sparkContext.getLocalProperty(pacing._ADDRESS) is None


def test_no_task_asks_after_a_refusal(spark, tmp_path):
    noted = notes(tmp_path)

    def get(url, headers=None):
        noted(f"{time.time():.6f}", "start")
        time.sleep(0.05)
        noted(f"{time.time():.6f}", "end")
        raise urllib.error.HTTPError(url, 401, "no", None, None)

    rows = spark.createDataFrame([(str(i), f"10.1/{i}", "t", "a") for i in range(200)], "publication_key string, doi string, title string, authors string")
    with pacing.leased(spark, {}):
        got = enrich.answers(rows, enrich.abstract_client(get), ["doi", "title", "authors"], "by-doi").collect()
    assert len(got) == 200 and all(r["answer"] is None for r in got)
    told = lines(tmp_path)
    first_end = min(float(t) for t, w in told if w == "end")
    assert all(float(t) <= first_end + 0.05 for t, w in told if w == "start") and sum(w == "start" for _, w in told) <= 4


def test_a_dead_task_holds_nobody_up(monkeypatch):
    monkeypatch.setattr(pacing, "ACK_S", 0.2)
    service = pacing._Service("127.0.0.1", {"c": 0.05})
    import threading

    threading.Thread(target=service.serve_forever, daemon=True).start()
    address = f"127.0.0.1:{service.server_address[1]}:{service.token}"
    try:
        dead, alive, stranger = pacing.Gate(address, "c"), pacing.Gate(address, "c"), pacing.Gate(address + "0", "c")
        assert dead._ask("start") == "go"  # and never says that it has begun
        begun = time.monotonic()
        alive.wait()
        alive.wait()
        assert 0.05 <= time.monotonic() - begun < 2
        with pytest.raises(pacing.Lost):
            stranger.wait()
        alive.refuse()
        with pytest.raises(pacing.Refused):
            alive.wait()
    finally:
        service.shutdown()
        service.server_close()
    assert isinstance(pacing.gate("c", 0.1), pacing.Spaced)
    alone = pacing.Spaced()
    alone.refuse()
    with pytest.raises(pacing.Refused):
        alone.wait()
