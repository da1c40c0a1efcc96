"""Markdown report and SVG figure from a few aggregated rows."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from html import escape


def signed(value: float | None, places: int = 4) -> str:
    return "n/a" if value is None or math.isnan(value) else f"{value:+.{places}f}"


NEGLIGIBLE, MATERIAL = 0.005, 0.02


def verdict(mean: float | None, t: float | None) -> str:
    if mean is None or t is None or math.isnan(t):
        return "Too few days to say anything about ranking."
    if abs(t) < 2:
        return f"The rank correlation of {signed(mean)} cannot be told from zero (t = {signed(t, 2)}); a short sample would look like this with or without an edge."
    return f"The forecasts rank issuers {'better' if mean > 0 else 'worse'} than chance (t = {signed(t, 2)}): one test on one sample."


def calibration(evaluation: Mapping, bands: Sequence[Mapping]) -> str:
    """What the stated chances are worth against constants: the rate known at each refit, then the scored period's own, known only afterwards."""
    skill, after = evaluation["brier_skill"], evaluation["brier_skill_scored_rate"]
    if skill is None or math.isnan(skill):
        return "Calibration cannot be judged."
    known = f"always forecasting the up-rate known at each refit ({evaluation['fitted_base_rate']:.1%} on average)"
    if abs(skill) < NEGLIGIBLE:
        parts = [f"As chances the forecasts are worth no more than {known}: Brier skill {signed(skill)}."]
    elif skill > 0:
        parts = [f"As chances the forecasts are worth a little more than {known}: Brier skill {signed(skill)}, a weaker claim than ranking."]
    else:
        parts = [f"As chances the forecasts are worth less than {known}: Brier skill {signed(skill)}."]
    if after is not None and not math.isnan(after):
        parts.append(f"With hindsight, against the scored period's own rate ({evaluation['base_rate']:.1%}), it is {signed(after)}.")
    if skill < NEGLIGIBLE:
        parts.append(bias(bands))
    return " ".join(p for p in parts if p)


def bias(bands: Sequence[Mapping]) -> str:
    """Which way the forecasts miss: the residual weighted by issuer-days, and whether the bands agree on its sign."""
    misses = [(b["mean_p"] - b["mean_y"], b["n"]) for b in bands if b["n"]]
    if not misses:
        return ""
    shift = sum(m * n for m, n in misses) / sum(n for _, n in misses)
    above, below = sum(m > 0 for m, _ in misses), sum(m < 0 for m, _ in misses)
    side = "high" if shift > 0 else "low"
    if abs(shift) >= MATERIAL:
        against = below if shift > 0 else above
        how = f"although {against} of {len(misses)} bands miss the other way" if against else "and every band agrees"
        return f"They run {side} by {abs(shift):.3f}, {how}."
    if above and below:
        return f"{above} bands run high and {below} low: scatter, not a shift."
    return f"They run slightly {side}, by {abs(shift):.3f}, in every band."


def table(head: Sequence[str], rows: Sequence[Sequence[object]]) -> str:
    lines = ["| " + " | ".join(head) + " |", "|" + "---|" * len(head)]
    return "\n".join(lines + ["| " + " | ".join(map(str, r)) + " |" for r in rows])


def group_section(title: str, rows: Sequence[Mapping], accounts: Mapping, name: str) -> str:
    """A breakdown with its account; a caveat where one row alone reaches significance; omitted without rows."""
    if not rows:
        return f"## {title}\n\nOmitted: no issuer-day has a group.\n"
    body = table(
        [name, "days", "issuer-days", "mean IC", "t"],
        [[r[name], r["days"], r["issuer_days"], signed(r["mean_ic"]), signed(r["t"], 2)] for r in sorted(rows, key=lambda r: str(r[name]))],
    )
    strong = [r for r in rows if r["t"] is not None and abs(r["t"]) >= 2]
    note = f"\n\nOnly {strong[0][name]} reaches |t| = 2; one of {len(rows)} rows does so by chance often enough." if len(strong) == 1 and len(rows) > 1 else ""
    whole = f"{accounts['total']} issuer-days = {accounts['in_rows']} in rows + {accounts['dropped']} dropped + {accounts['ungrouped']} without group."
    return f"## {title}\n\n{body}{note}\n\n{whole}\n"


def baseline_report(evaluation: Mapping, bands: Sequence[Mapping], weights: Mapping[str, float], sections: Sequence[str] = ()) -> str:
    ordered = sorted(weights.items(), key=lambda w: (-abs(w[1]), w[0]))
    parts = [
        "# Baseline forecasts\n", f"{verdict(evaluation['mean_ic'], evaluation['t'])} {calibration(evaluation, bands)}\n",
        table(["statistic", "value"], [
            ["scored days", evaluation["days"]], ["mean IC", signed(evaluation["mean_ic"])], ["error", signed(evaluation["error"])], ["t", signed(evaluation["t"], 2)],
            ["Brier skill, fitted rate", signed(evaluation["brier_skill"])], ["Brier skill, scored rate", signed(evaluation["brier_skill_scored_rate"])],
            ["fitted up-rate", f"{evaluation['fitted_base_rate']:.1%}"], ["scored up-rate", f"{evaluation['base_rate']:.1%}"], ["scored events", evaluation["test_events"]],
        ]),
        "\n## Calibration\n", table(["band", "forecast", "realised", "n"], [[f"{b['lower']:.1f}–{b['upper']:.1f}", f"{b['mean_p']:.3f}", f"{b['mean_y']:.3f}", b["n"]] for b in sorted(bands, key=lambda b: b["band"])]),
        "\n## Weights\n", table(["feature", "weight"], [[n, signed(w)] for n, w in ordered]), *sections,
    ]
    return "\n".join(parts) + "\n"


def baseline_figure(daily: Sequence[tuple[str, float]], bands: Sequence[Mapping], width: int = 900, height: int = 320) -> str:
    """Daily rank correlations as bars beside the reliability curve."""
    half, pad = width / 2, 40
    reach = max([0.1, *(abs(v) for _, v in daily)])
    step = (half - 2 * pad) / max(1, len(daily))
    middle = height / 2
    bars = [
        f'<rect x="{pad + k * step:.1f}" y="{middle - max(v, 0) / reach * (middle - pad):.1f}" width="{step * 0.8:.1f}" height="{abs(v) / reach * (middle - pad):.1f}"><title>{escape(str(d))} {signed(v)}</title></rect>'
        for k, (d, v) in enumerate(daily)
    ]
    side = height - 2 * pad
    dots = [f'<circle cx="{half + pad + b["mean_p"] * side:.1f}" cy="{height - pad - b["mean_y"] * side:.1f}" r="{2 + math.log1p(b["n"]):.1f}"/>' for b in bands]
    axis = f'<line x1="{pad}" y1="{middle}" x2="{half - pad}" y2="{middle}" stroke="#888"/><line x1="{half + pad}" y1="{height - pad}" x2="{half + pad + side}" y2="{pad}" stroke="#888"/>'
    heads = f'<text x="{pad}" y="20">Daily rank correlation</text><text x="{half + pad}" y="20">Forecast against realised</text>'
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}" font-family="sans-serif" font-size="13">{heads}{axis}<g fill="#37c">{"".join(bars)}{"".join(dots)}</g></svg>\n'
