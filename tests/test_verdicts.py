"""Verdicts in prose against plain trying of every end, and concurrent second opinions."""

import json
import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from lumigate.functions import verdicts
from lumigate.functions.text import parse_verdict
from lumigate.operators import refine


def plain(text):
    """From each opening brace on, each closing one in turn."""
    for i in (i for i, c in enumerate(text) if c == "{"):
        for j in (j for j, c in enumerate(text) if c == "}" and j > i):
            try:
                return json.loads(text[i : j + 1])
            except ValueError:
                continue
    return None


CASES = {
    'I say {"k": 0.4, "note": "a } b"} ok': {"k": 0.4}, '{not json {"k": 0.3}}': {"k": 0.3}, '{"a": {"b": {"c": {"d": {}}}}, "k": 0.4} done': {"k": 0.4},
    '```json\n{"k": 2, "j": -1}\n```': {"k": 1.0, "j": 0.0}, "not JSON": None, "[1, 2]": None, "": None, None: None, "{": None, "}{": None, "{} then": {}, '{"k": true} and': {"k": 1.0},
    '{"k": "0.25"} x': {"k": 0.25}, '{"k": NaN} x': {}, '{"k": 1e999} x': {}, '{"k": null} x': {}, '{"k": [1]} x': {}, 'a quote " {"k": 0.5} " b': {"k": 0.5}, "5": None, '"{"': None,
}


def test_verdicts(spark):
    rows = spark.createDataFrame(list(enumerate(CASES)), "i int, text string")
    got = {r.text: r.v for r in rows.select("text", parse_verdict(F.col("text"), ["k", "j"]).alias("v")).collect()}
    assert got == CASES


def test_the_first_object_is_that_of_trying_every_end():
    rnd = random.Random(2)
    parts = ["{", "}", '"', "\\", "a", ":", "1", ",", '{"k": 1}', '{"k": {"j": 2}}', " ", '"}"']
    for _ in range(4000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14)))
        assert verdicts.first_object(text) == plain(text), text


@pytest.mark.parametrize("text", ['{"a":' * 200_000, '{"a":' * 100_000 + "1" + "}" * 100_000, "{" * 1_000_000, '{"' * 300_000, '{"a": "' + "{" * 300_000, '{"k": 1, "x": "' + "y" * 2_000_000])
def test_long_texts_take_time_in_proportion(text):
    began = time.process_time()
    verdicts.first_object(text)
    assert time.process_time() - began < 20


class Judge:
    def __init__(self, seconds, fails=()):
        self.seconds, self.fails, self.open, self.most, self.lock = seconds, fails, 0, 0, threading.Lock()

    def __call__(self, item):
        with self.lock:
            self.open += 1
            self.most = max(self.most, self.open)
        try:
            time.sleep(self.seconds.get(item, 0.02) if isinstance(self.seconds, dict) else self.seconds)
            if item in self.fails:
                raise RuntimeError("no answer")
            return f"says {item}"
        finally:
            with self.lock:
                self.open -= 1


def test_a_bounded_number_of_calls_is_open_and_order_stays():
    judge = Judge(0.05, fails=(3,))
    began = time.monotonic()
    out = list(refine.Window(judge, 5, 10).answers(range(20)))
    assert out == [None if i == 3 else f"says {i}" for i in range(20)]
    assert judge.most == 5 and time.monotonic() - began < 0.6


def test_slow_calls_give_none_and_do_not_hold_the_others():
    judge = Judge({4: 1.5})
    began = time.monotonic()
    out = list(refine.Window(judge, 3, 0.3).answers(range(12)))
    assert out == [None if i == 4 else f"says {i}" for i in range(12)] and time.monotonic() - began < 1.2


def test_a_judge_that_hangs_is_asked_no_more_than_it_can_bear():
    judge = Judge(30)
    assert list(refine.Window(judge, 2, 0.1).answers(range(6))) == [None] * 6 and judge.most == 2


def test_input_is_taken_as_calls_come_free():
    taken = []

    def items():
        for i in range(50):
            taken.append(i)
            yield i

    answers = refine.Window(Judge(0.01), 4, 5).answers(items())
    next(answers)
    assert len(taken) <= 5


def test_judged_in_spark(spark):
    def judge():
        def ask(item):
            time.sleep(1.0 if item == 7 else 0.01)
            return None if item % 2 else f"{item}"

        return ask

    rows = spark.range(20).withColumnRenamed("id", "item_id")
    assert {r.item_id: r.text for r in refine.judged(rows, judge, 3, 0.4).collect()} == {i: None if i % 2 else f"{i}" for i in range(20)}
