"""Parameters of one environment: grid, window, gap policy, features, split."""

from __future__ import annotations

from dataclasses import dataclass

# A series never has more rows than its window has buckets, so this is also the
# most rows that any per-series window or group can bring into one task.
MAX_WINDOW_BUCKETS = 1_000_000


@dataclass(frozen=True)
class FleetSpec:
    """The defaults: five-minute buckets over eight days, one day as season."""

    # Results are only comparable when these defaults stay as they are.
    grid_s: int = 300
    n_buckets: int = 2304
    clip: tuple[float, float] = (0.0, 100.0)
    max_gap: int = 2
    max_lag: int = 24
    horizons: tuple[int, ...] = (1, 6, 12)
    lags: tuple[int, ...] = (1, 2, 3, 6, 12, 24)
    roll_widths: tuple[int, ...] = (6, 12)
    ma_width: int = 6
    season: int = 288
    train_pct: int = 70
    val_pct: int = 15
    n_folds: int = 5
    min_mean: float = 1.0
    min_unique: int = 3
    min_valid_rows: int = 500

    def __post_init__(self):
        if not 0 < self.n_buckets <= MAX_WINDOW_BUCKETS:
            raise ValueError(
                f"n_buckets must be in 1..{MAX_WINDOW_BUCKETS}; use a coarser grid or "
                "cut a longer history into one environment per period"
            )
        if self.grid_s <= 0:
            raise ValueError("grid_s must be positive")
        if self.max_gap < 0:
            raise ValueError("max_gap must not be negative")
        if any(h < 1 for h in self.horizons):
            raise ValueError("every horizon must be at least 1")

    @property
    def judge_h(self) -> int:
        """Horizon whose valid-row count decides whether a series is long enough."""
        return max(self.horizons)

    @property
    def bounds(self) -> dict[str, tuple[int, int]]:
        """Half-open offset ranges of train, validation and test.

        Integer arithmetic: a product such as ``720 * 0.70`` falls just below 504
        in floating point and would lose a bucket.
        """
        n_train = self.n_buckets * self.train_pct // 100
        n_val = self.n_buckets * self.val_pct // 100
        return {
            "train": (0, n_train),
            "val": (n_train, n_train + n_val),
            "test": (n_train + n_val, self.n_buckets),
        }

    @property
    def fit_bounds(self) -> tuple[int, int]:
        """Range the final model is fitted on: train and validation together."""
        return 0, self.bounds["val"][1]

    @property
    def fold_bounds(self) -> list[tuple[int, int, int]]:
        """Expanding rolling-origin folds as ``(fold, train_end, val_end)``."""
        lo, hi = self.bounds["val"]
        if (hi - lo) % self.n_folds:
            raise ValueError(
                f"validation range of {hi - lo} buckets does not divide into {self.n_folds} folds"
            )
        step = (hi - lo) // self.n_folds
        return [(i, lo + i * step, lo + (i + 1) * step) for i in range(self.n_folds)]
