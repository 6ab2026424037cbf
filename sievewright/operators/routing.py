"""Actions of a round by name: each checks its parameters, runs, and is tried again if it fails."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any


@dataclass
class Action:
    """run(state, **parameters) -> output; needs: names and types of its parameters."""

    run: Callable[..., Any]
    needs: dict[str, type | tuple[type, ...]] = field(default_factory=dict)
    retries: int = 3

    def problem(self, parameters: dict[str, Any]) -> str | None:
        """What is wrong with the parameters, or None."""
        missing = sorted(self.needs.keys() - parameters.keys())
        if missing:
            return f"missing parameters: {', '.join(missing)}"
        wrong = sorted(k for k, kind in self.needs.items() if not isinstance(parameters[k], kind))
        return f"parameters of another type: {', '.join(wrong)}" if wrong else None


@dataclass
class Result:
    success: bool
    output: Any = None
    error: str | None = None
    attempts: int = 0


class Router:
    """Runs registered actions. A DataFrame that an action returns is a plan; Spark retries its tasks when it is written."""

    def __init__(self, wait: float = 0.0):
        self.actions: dict[str, Action] = {}
        self.wait = wait

    def register(self, name: str, run: Callable[..., Any], retries: int = 3, **needs: type | tuple[type, ...]) -> None:
        self.actions[name] = Action(run, needs, max(1, retries))

    def execute(self, name: str, parameters: dict[str, Any], state: Any = None) -> Result:
        """The action's output, or why there is none; never raises what an action raises."""
        action = self.actions.get(name)
        if action is None:
            return Result(False, error=f"unknown action {name!r}; there are {sorted(self.actions)}")
        if problem := action.problem(parameters):
            return Result(False, error=problem)
        error = ""
        for attempt in range(1, action.retries + 1):
            try:
                return Result(True, action.run(state, **parameters), attempts=attempt)
            except Exception as e:  # noqa: BLE001  an action may fail in any way
                error = f"{type(e).__name__}: {e}"
                if attempt < action.retries:
                    time.sleep(self.wait * attempt)
        return Result(False, error=error, attempts=action.retries)
