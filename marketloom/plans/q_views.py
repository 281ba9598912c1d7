"""The derived market tables themselves (scan, key derivation, consolidation of raw rows)."""
from marketloom.functions.scalar import rnd
from marketloom.plans import sqlviews as S
from marketloom.plans.registry import register
from marketloom.sources import views as V


def _rounded(df, cols):
    return df.withColumns({c: rnd(c, 6) for c in cols})


def _reg(name, view, rounded):
    cols = ", ".join(f"{S.rnd(c, 6)} AS {c}" for c in rounded)
    sel = f"SELECT * REPLACE ({cols}) FROM {view}" if rounded else f"SELECT * FROM {view}"
    register(name, S.sql(view, sel))(lambda spark, d, v=view, r=rounded: _rounded(getattr(V, v)(spark, d), r))


_reg("src_01_daily_bars", "bars", ["open", "high", "low", "close"])
_reg("src_01_minute_bars", "minute_bars", [])
_reg("src_01_trades", "trades", ["price"])
_reg("src_01_financial_facts", "facts", ["value"])
_reg("src_01_eps_facts", "eps_facts", ["value"])
_reg("src_01_estimates", "estimates", ["eps_average", "eps_high", "eps_low", "eps_7d", "eps_30d"])
_reg("src_01_filings", "filings", [])
_reg("src_01_research_events", "research_events", [])
_reg("src_01_macro_bars", "macro_bars", ["close"])
_reg("src_01_relationships", "relationships", [])
_reg("src_18_universe", "securities", [])
