"""Units, thermodynamics and cosmology as columns, with the constants of one run in a SimContext."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import col, log_or_null, on_grid

# Cgs constants.
BOLTZMANN, PROTON, GRAVITY, LIGHT, THOMSON, SOLAR_MASS = 1.380650e-16, 1.672622e-24, 6.6738e-8, 2.9979e10, 6.6524e-25, 1.98892e33
KPC_CM, YEAR_S = 3.085678e21, 3.15576e7
# Gray opacity (cm^2) and photoionisation rate (1/s) of the ultraviolet background at these redshifts.
UVB_Z = [0, 1, 2, 3, 4, 5, 6, 7, 8, 22]
UVB_OPACITY = [2.59e-18, 2.37e-18, 2.27e-18, 2.15e-18, 2.02e-18, 1.94e-18, 1.82e-18, 1.71e-18, 1.60e-18, 2.8e-20]
UVB_GAMMA = [3.99e-14, 3.03e-13, 6e-13, 5.53e-13, 4.31e-13, 3.52e-13, 2.678e-13, 1.81e-13, 9.43e-14, 1e-20]


@dataclass(frozen=True)
class SimContext:
    """Parameters of a run that jobs take as plain numbers."""

    box: float = 1000.0
    h: float = 0.6774
    omega_m: float = 0.3089
    scale_factor: float = 1.0
    mass_unit: float = 1e10  # solar masses / h
    gamma: float = 5.0 / 3.0
    hydrogen: float = 0.76

    @property
    def redshift(self) -> float:
        return 1 / self.scale_factor - 1

    # units
    def mass_msun(self, m) -> Column:
        return col(m) * (self.mass_unit / self.h)

    def log_mass(self, m) -> Column:
        return log_or_null(self.mass_msun(m))

    def length_kpc(self, x) -> Column:
        return col(x) * (self.scale_factor / self.h)

    def area_kpc2(self, x) -> Column:
        return col(x) * (self.scale_factor / self.h) ** 2

    def volume_kpc3(self, x) -> Column:
        return col(x) * (self.scale_factor / self.h) ** 3

    def velocity_kms(self, v) -> Column:
        return col(v) * math.sqrt(self.scale_factor)

    def density_cgs(self, rho) -> Column:
        unit = self.mass_unit / self.h * SOLAR_MASS / (self.scale_factor / self.h * KPC_CM) ** 3
        return col(rho) * unit

    def number_density(self, rho) -> Column:
        return self.density_cgs(rho) / PROTON

    # thermodynamics
    def temperature(self, u, xe) -> Column:
        """Kelvin from specific energy ((km/s)^2) and electrons per hydrogen atom."""
        weight = 4.0 / (1.0 + 3.0 * self.hydrogen + 4.0 * self.hydrogen * col(xe))
        return col(u) * ((self.gamma - 1) / BOLTZMANN * 1e10 * PROTON) * weight

    def pressure(self, u, rho) -> Column:
        return col(u) * col(rho) * (self.gamma - 1)

    def entropy(self, u, rho) -> Column:
        return self.pressure(u, rho) / F.pow(col(rho), F.lit(self.gamma))

    def sound_speed(self, u) -> Column:
        return F.sqrt(col(u) * (self.gamma * (self.gamma - 1)))

    def jeans_mass(self, u, rho) -> Column:
        c = self.sound_speed(u)
        return F.lit(math.pi ** 2.5 / 6) * F.pow(c, F.lit(3.0)) / F.sqrt(col(rho))

    def magnetic_pressure(self, b) -> Column:
        return col(b) * col(b) / (8 * math.pi)

    # black holes and winds
    def eddington_rate(self, mass, efficiency: float = 0.2) -> Column:
        """Solar masses a year."""
        return self.mass_msun(mass) * (4 * math.pi * GRAVITY * PROTON / (efficiency * THOMSON * LIGHT) * YEAR_S)

    def eddington_luminosity(self, mass) -> Column:
        return self.mass_msun(mass) * (4 * math.pi * GRAVITY * PROTON * LIGHT / THOMSON * SOLAR_MASS)

    def wind_energy(self, metallicity, energy: float = 3.6, floor: float = 0.25, reference: float = 0.002, power: float = 2.0, per_mass: float = 0.0118) -> Column:
        """Specific energy of a wind, lowered towards `floor` at high metallicity."""
        return (F.lit(floor) + (1 - floor) / (1 + F.pow(col(metallicity) / reference, F.lit(power)))) * (energy * per_mass)

    # cosmology
    def age_gyr(self, z) -> Column:
        """Age of a flat universe; null for negative redshifts."""
        z, lam = col(z), 1 - self.omega_m
        arg = F.pow(1 + z, F.lit(-1.5)) * math.sqrt(lam / self.omega_m)
        return F.when(z >= 0, F.asinh(arg) * (2 / (100 * self.h * 3 * math.sqrt(lam)) * (3.085678e19 / YEAR_S / 1e9)))

    def redshift_at(self, age) -> Column:
        lam = 1 - self.omega_m
        arg = col(age) * (100 * self.h * 3 * math.sqrt(lam) * YEAR_S * 1e9 / 2 / 3.085678e19)
        return F.when(col(age) > 0, F.pow(F.sinh(arg) / math.sqrt(lam / self.omega_m), F.lit(-2.0 / 3.0)) - 1)

    def distance_table(self, z_max: float = 4.0, points: int = 81, inner: int = 50) -> tuple[list[float], list[float]]:
        """Comoving distance (Mpc) at equal redshifts, by the trapezoid rule on a finer grid."""
        zs = [z_max * k / (points - 1) for k in range(points)]
        inverse = lambda z: 299792.458 / (100 * self.h * math.sqrt(self.omega_m * (1 + z) ** 3 + 1 - self.omega_m))
        out, total = [0.0], 0.0
        for a, b in zip(zs, zs[1:]):
            step = (b - a) / inner
            total += sum((inverse(a + i * step) + inverse(a + (i + 1) * step)) / 2 * step for i in range(inner))
            out.append(total)
        return zs, out

    def comoving_distance(self, z) -> Column:
        return on_grid(z, *self.distance_table())

    def neutral_fraction(self, n_h, temperature, redshift: float = 0.0) -> Column:
        """Neutral hydrogen fraction with self-shielding: photoionisation falls off above a density that grows with temperature."""
        n, t = col(n_h), col(temperature)
        opacity, gamma = (float(np.interp(redshift, UVB_Z, table)) for table in (UVB_OPACITY, UVB_GAMMA))
        # Fixed values of the published fits of self-shielding, recombination and collisional ionisation.
        n_shield = 6.73e-3 * (opacity / 2.49e-18) ** (-2 / 3) * (gamma / 1e-12) ** (2 / 3) * (0.167 / 0.17) ** (-1 / 3) * F.pow(t / 1e4, F.lit(0.17))
        ratio = n / n_shield
        rate = (0.98 * F.pow(1 + F.pow(ratio, F.lit(1.64)), F.lit(-2.28)) + 0.02 * F.pow(1 + ratio, F.lit(-0.84))) * gamma
        lam = F.lit(315614.0) / t
        recombine = 1.269e-13 * F.pow(lam, F.lit(1.503)) / F.pow(1 + F.pow(lam / 0.522, F.lit(0.47)), F.lit(1.923))
        collide = 1.17e-10 * F.sqrt(t) * F.exp(F.lit(-157809.0) / t) / (1 + F.sqrt(t / 1e5))
        a, b = recombine + collide, 2 * recombine + rate / n + collide
        return (b - F.sqrt(b * b - 4 * a * recombine)) / (2 * a)
