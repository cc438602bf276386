"""Example sequences with known results, on the transition table."""

import random

import pytest

from tidefold.plans.transitions import ListState, MapState, QueueState


def test_map_sequence():
    a, b = MapState(), MapState()
    assert a.apply("get_or_create", "1111") == ("CreatedNew", "1111")
    assert a.apply("replace", "2222") == ("PrevValue", "1111")
    assert a.apply("get") == ("Found", "2222")
    assert a.apply("get_or_create", "1111") == ("ExistingValue", "2222")
    assert b.apply("replace", "3333") == ("DoesNotExist", None)
    assert b.apply("set", "4444") == ("CreatedNew", None)
    assert b.apply("set", "5555") == ("PrevValue", "4444")
    assert b.apply("get_or_create", "6666") == ("ExistingValue", "5555")
    assert a.apply("replace", "6666", expected="2222") == ("PrevValue", "2222")
    assert a.apply("replace", "7777", expected="2222") == ("WrongValue", "6666")
    assert a.apply("remove") == ("Removed", "6666") and a.apply("remove") == ("None", None)


def test_list_order_and_lengths():
    texas = ListState()
    for item, val in (("dallas", 1), ("austin", 2), ("houston", 3), ("dallas", 4)):
        texas.apply("set", item, val)
    assert [(i, v) for _, i, v in texas.ordered()] == [("dallas", 4), ("austin", 2), ("houston", 3)]
    xxx = ListState()
    for k in "1234":
        xxx.apply("set", k, 0)
    assert [(xxx.apply("remove", k), len(xxx))[1] for k in "3142"] == [3, 2, 1, 0]


def test_promotion():
    lst, order = ListState(), lambda: "".join(i for _, i, _ in lst.ordered())
    for k in "1234":
        lst.apply("set", k, 0)
    lst.apply("set", "2", 1)
    assert order() == "1234"
    assert lst.apply("promote", "2", 1) == ("CreatedNew", None)
    assert order() == "1342"
    lst.apply("promote", "1", 1)
    assert order() == "3421"
    lst.apply("promote", "1", 1)
    assert order() == "3421"


def test_documented_compare_and_swap_in_lists():
    """A list's replace compares the value; a build that compares the item's index would say WrongValue."""
    lst = ListState()
    lst.apply("set", "a", "x")
    assert lst.apply("replace", "a", "y", expected="x") == ("PrevValue", "x")


def test_compaction_keeps_order():
    lst = ListState()
    for i in range(1000):
        lst.apply("set", i, i)
    assert not lst.compact()
    for i in range(1, 1000, 3):
        lst.apply("remove", i)
    before = [i for _, i, _ in lst.ordered()]
    assert lst.compact() and not lst.compact()
    assert [i for _, i, _ in lst.ordered()] == before and lst.holes == 0


def test_deque_and_holes():
    q = QueueState()
    for op, v in [("push_tail", v) for v in (100, 101, 102)] + [("push_head", v) for v in (103, 104, 105)]:
        q.apply(op, v)
    assert [q.values[i] for i in sorted(q.values)] == [105, 104, 103, 100, 101, 102]
    work = QueueState()
    idx = [work.apply("push_tail", v)[0] for v in range(1000, 2000)]
    for i in idx[::5]:
        assert work.apply("remove", idx=i)[1] is not None
    assert len(work) == 800
    got = [work.apply("pop_head" if k % 2 else "pop_tail")[1] for k in range(800)]
    assert sorted(got) == [v for v in range(1000, 2000) if v % 5] and work.apply("pop_head") == (None, None)
    assert work.apply("push_head", 7) == (0, 7)


def test_conservation():
    rng, lst, made, gone = random.Random(7), ListState(), 0, 0
    for _ in range(5000):
        op = rng.choice(["set", "get_or_create", "promote", "remove", "replace"])
        item, had = rng.randrange(40), None
        had = item in lst.items
        lst.apply(op, item, rng.randrange(9) + 1)
        made += (not had) and item in lst.items
        gone += had and item not in lst.items
        assert lst.holes >= 0
    assert made - gone == len(lst)


def test_unknown_operation():
    with pytest.raises(ValueError):
        MapState().apply("upsert", 1)
