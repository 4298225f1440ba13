"""Constants of the analytics, as typed values."""

from __future__ import annotations

from dataclasses import dataclass

# --- fixed values -----------------------------------------------------------


@dataclass(frozen=True)
class Timeframe:
    """Settings of one signal horizon."""

    name: str
    rsi_lookback: int
    macd_lookback: int
    band_lookback: int
    signal_lookback: int
    macd_fast: int
    macd_slow: int
    macd_signal: int
    macd_threshold: float
    macd_min_rows: int
    band_min_rows: int
    oversold: float
    overbought: float
    near_high: float
    near_low: float
    hold_days: int
    report_hold_days: int
    win_pct: float
    volatility_min: float
    volatility_max: float
    volume_min: int
    volatility_days: int
    min_probability: float
    backtest_days: int
    performance_days: int
    take_profit_1: float
    take_profit_2: float
    stop_loss: float


DAILY = Timeframe(
    name="DAILY",
    rsi_lookback=100, macd_lookback=150, band_lookback=50, signal_lookback=300,
    macd_fast=12, macd_slow=26, macd_signal=9, macd_threshold=0.0,
    macd_min_rows=30, band_min_rows=20,
    oversold=30.0, overbought=70.0, near_high=0.8, near_low=0.2,
    hold_days=5, report_hold_days=5, win_pct=2.0,
    volatility_min=1.0, volatility_max=4.0, volume_min=1_000_000, volatility_days=30,
    min_probability=0.8, backtest_days=180, performance_days=60,
    take_profit_1=1.05, take_profit_2=1.10, stop_loss=0.97,
)
WEEKLY = Timeframe(
    name="WEEKLY",
    rsi_lookback=180, macd_lookback=250, band_lookback=150, signal_lookback=365,
    macd_fast=12, macd_slow=26, macd_signal=9, macd_threshold=0.03,
    macd_min_rows=40, band_min_rows=30,
    oversold=35.0, overbought=65.0, near_high=0.75, near_low=0.25,
    hold_days=15, report_hold_days=10, win_pct=3.0,
    volatility_min=1.5, volatility_max=5.0, volume_min=5_000_000, volatility_days=90,
    min_probability=0.75, backtest_days=365, performance_days=90,
    take_profit_1=1.08, take_profit_2=1.15, stop_loss=0.95,
)
MONTHLY = Timeframe(
    name="MONTHLY",
    rsi_lookback=730, macd_lookback=730, band_lookback=300, signal_lookback=730,
    macd_fast=26, macd_slow=52, macd_signal=18, macd_threshold=0.05,
    macd_min_rows=60, band_min_rows=40,
    oversold=40.0, overbought=60.0, near_high=0.7, near_low=0.3,
    hold_days=20, report_hold_days=20, win_pct=5.0,
    volatility_min=2.0, volatility_max=8.0, volume_min=10_000_000, volatility_days=180,
    min_probability=0.7, backtest_days=730, performance_days=365,
    take_profit_1=1.12, take_profit_2=1.20, stop_loss=0.92,
)
TIMEFRAMES = {tf.name: tf for tf in (DAILY, WEEKLY, MONTHLY)}

TRIGGER_WEIGHTS = {
    "rsi_oversold": 1.0,
    "macd_bullish": 1.0,
    "volume_shock": 1.0,
    "demand_zone": 2.0,
    "bullish_engulfing": 2.0,
    "bollinger_oversold": 1.0,
}

RSI_GRID = {
    "period": [7, 9, 11, 14, 21],
    "oversold": [20, 25, 30, 35],
    "overbought": [65, 70, 75, 80],
}
MACD_GRID = {
    "fast_period": [8, 10, 12, 16],
    "slow_period": [21, 26, 30, 35],
    "signal_period": [7, 9, 12, 14],
}

FIBONACCI = (0.236, 0.382, 0.5, 0.618)
