"""The transition table: state before, operation -> state after, status, result.

The one definition of what each operation does, used by the ordered batch fold,
by the streaming processor and, in tests, against the window formulations.
Indices start at 0 and grow both ways.
"""

from __future__ import annotations

from typing import Any


class MapState:
    """One key of the flat map. A null is a value like any other: ``live`` says whether the key is there."""

    def __init__(self, value: Any = None, live: bool | None = None):
        self.value, self.live = value, value is not None if live is None else live

    def apply(self, op: str, val: Any = None, expected: Any = None) -> tuple[str, Any]:
        old, live = self.value, self.live
        if op == "get":
            return ("Found" if live else "None"), old
        if op == "remove":
            self.value, self.live = None, False
            return ("Removed" if live else "None"), old
        if op == "set":
            self.value, self.live = val, True
            return ("PrevValue" if live else "CreatedNew"), old
        if op == "get_or_create":
            if live:
                return "ExistingValue", old
            self.value, self.live = val, True
            return "CreatedNew", val
        if op == "replace":
            if not live:
                return "DoesNotExist", None
            if expected is not None and old != expected:
                return "WrongValue", old
            self.value = val
            return "PrevValue", old
        raise ValueError(f"unknown operation {op}")


class ListState:
    """An insertion-ordered map with promotion; removals inside leave holes until compaction."""

    def __init__(self):
        self.items: dict[Any, MapState] = {}
        self.index: dict[Any, int] = {}
        self.at: dict[int, Any] = {}
        self.head = self.tail = 0

    def __len__(self) -> int:
        return len(self.items)

    @property
    def span(self) -> int:
        return self.tail - self.head

    @property
    def holes(self) -> int:
        return self.span - len(self)

    def apply(self, op: str, item: Any, val: Any = None, expected: Any = None) -> tuple[str, Any]:
        if op == "promote":
            self.apply("remove", item)
            op = "set"
        state = self.items.get(item) or MapState()
        status, result = state.apply(op, val, expected)
        if item not in self.items and state.live:
            self.items[item], self.index[item], self.at[self.tail] = state, self.tail, item
            self.tail += 1
        elif item in self.items and not state.live:
            self._drop(item)
        return status, result

    def _drop(self, item: Any) -> None:
        idx = self.index.pop(item)
        del self.items[item], self.at[idx]
        if idx == self.head:
            self.head += 1
        elif idx == self.tail - 1:
            self.tail -= 1
        if self.head == self.tail:  # an empty list starts again
            self.head = self.tail = 0

    def ordered(self) -> list[tuple[int, Any, Any]]:
        return [(i, self.at[i], self.items[self.at[i]].value) for i in sorted(self.at)]

    def pop(self, end: str) -> tuple[Any, Any] | None:
        if not self.at:
            return None
        item = self.at[min(self.at) if end == "head" else max(self.at)]
        value = self.items[item].value
        self._drop(item)
        return item, value

    def compact(self, min_length: int = 100, min_holes_ratio: float = 0.25) -> bool:
        if self.span < min_length or self.holes < self.span * min_holes_ratio:
            return False
        order = self.ordered()
        start = self.tail
        self.at = {start + k: item for k, (_, item, _) in enumerate(order)}
        self.index = {item: i for i, item in self.at.items()}
        self.head, self.tail = (start, start + len(order)) if order else (0, 0)
        return True


class QueueState:
    """A double-ended queue addressed by index."""

    def __init__(self, head: int = 0, tail: int = 0, values: dict[int, Any] | None = None):
        self.head, self.tail, self.values = head, tail, dict(values or {})

    def __len__(self) -> int:
        return len(self.values)

    def _rest(self) -> None:
        if self.head >= self.tail:
            self.head = self.tail = 0

    def apply(self, op: str, val: Any = None, idx: int | None = None) -> tuple[int | None, Any]:
        """(index touched, value) of a push, pop, or removal by index; (None, None) where nothing was there."""
        if op == "push_tail" or op == "push_head" and self.head == self.tail:
            self.values[self.tail] = val
            self.tail += 1
            return self.tail - 1, val
        if op == "push_head":
            self.head -= 1
            self.values[self.head] = val
            return self.head, val
        if op in ("pop_head", "pop_tail"):
            while self.head < self.tail:
                if op == "pop_head":
                    at, self.head = self.head, self.head + 1
                else:
                    at = self.tail = self.tail - 1
                if at in self.values:
                    out = self.values.pop(at)
                    self._rest()
                    return at, out
            self._rest()
            return None, None
        if op == "load":  # an element of a stored queue, at its place
            if not self.values and self.head == self.tail:
                self.head = self.tail = idx
            self.values[idx] = val
            self.head, self.tail = min(self.head, idx), max(self.tail, idx + 1)
            return idx, val
        if op == "remove":
            if idx not in self.values:
                return None, None
            out = self.values.pop(idx)
            if idx == self.head:
                self.head += 1
            if idx == self.tail - 1:
                self.tail -= 1
            self._rest()
            return idx, out
        raise ValueError(f"unknown operation {op}")
