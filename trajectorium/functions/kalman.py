"""Constant-velocity Kalman filter in the plane, for Python functions over one track."""

from __future__ import annotations

from collections.abc import Sequence


class Filter:
    """State (x, y, vx, vy), seen as (x, y). start: first position; noise: of the measurement; drift: of each step's state.

    Nothing couples the two axes, so each has a covariance of its own, of place
    and speed, and all is plain numbers: arrays this small cost more than their sums.
    """

    __slots__ = ("x", "p", "noise", "drift", "dt")

    def __init__(self, start: Sequence[float], spread: float = 10.0, noise: float = 0.01, drift: tuple[float, ...] = (0.01, 0.01, 0.05, 0.05), dt: float = 1.0):
        self.x = (float(start[0]), float(start[1]), 0.0, 0.0)
        #: By axis: variance of the place, covariance, variance of the speed.
        self.p = ((spread, 0.0, spread),) * 2
        self.noise, self.drift, self.dt = noise, drift, dt

    def copy(self) -> Filter:
        new = Filter.__new__(Filter)
        new.x, new.p, new.noise, new.drift, new.dt = self.x, self.p, self.noise, self.drift, self.dt
        return new

    def predict(self) -> tuple[float, float]:
        dt, q = self.dt, self.drift
        x, y, vx, vy = self.x
        self.x = (x + dt * vx, y + dt * vy, vx, vy)
        new = []
        for k, (a, b, c) in enumerate(self.p):
            both = b + dt * c
            new.append((a + dt * b + dt * both + q[k], both, c + q[k + 2]))
        self.p = tuple(new)
        return self.x[:2]

    def update(self, seen: Sequence[float]) -> tuple[float, float]:
        x, new = list(self.x), []
        for k, (a, b, c) in enumerate(self.p):
            s = a + self.noise
            far, near, fast = float(seen[k]) - x[k], a / s, b / s
            x[k] += near * far
            x[k + 2] += fast * far
            new.append((a - near * a, b - near * b, c - fast * b))
        self.x, self.p = tuple(x), tuple(new)
        return self.x[:2]
