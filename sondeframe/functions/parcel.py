"""A rising parcel: dry to its condensation level, then along the moist adiabat."""

from __future__ import annotations

import math

#: Gas constant and heat capacity of dry air, heat of condensation, ratio of the gas constants, and the steps' depth in Pa.
GAS, HEAT, LATENT, RATIO = 287.05, 1004.0, 2.501e6, 0.622
STEP = 500.0


class Parcel:
    """Temperatures (K) of a parcel of temperature t and dew point td at pressure p (Pa), asked for at falling pressures."""

    def __init__(self, t: float, td: float, p: float, kappa: float) -> None:
        self.t0, self.p0, self.kappa = t, p, kappa
        self.t = 1 / (1 / (td - 56) + math.log(t / td) / 800) + 56 if td < t else t
        self.lcl = p * (self.t / t) ** (1 / kappa)
        self.p = self.lcl

    @staticmethod
    def rate(t: float, p: float) -> float:
        """Warming along the moist adiabat, in K/Pa."""
        e = 611.2 * math.exp(17.67 * (t - 273.15) / (t - 29.65))
        r = RATIO * e / (p - e)
        return (GAS * t + LATENT * r) / (HEAT + LATENT**2 * r * RATIO / (GAS * t**2)) / p

    def at(self, p: float) -> float:
        if p >= self.lcl:
            return self.t0 * (p / self.p0) ** self.kappa
        steps = max(1, math.ceil((self.p - p) / STEP))
        dp = (p - self.p) / steps
        for _ in range(steps):
            half = self.t + self.rate(self.t, self.p) * dp / 2
            self.t += self.rate(half, self.p + dp / 2) * dp
            self.p += dp
        return self.t
