"""Writers: parquet, CSV with fixed decimals, compressed JSON lines, JSON, result tables."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parquet(rows: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    writer = rows.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def daily_sentiment_csv(daily: DataFrame, path: str, files: int | None = 1) -> None:
    """Sorted by date, ticker, model; six, six and three decimals. One file for a small result, ``files=None`` to leave the partitioning."""
    out = daily.select(
        "date", "ticker", "model",
        F.format_string("%.6f", "sentiment_avg").alias("sentiment_avg"), F.format_string("%.6f", "sentiment_disp").alias("sentiment_disp"),
        "mention_count", F.format_string("%.3f", "weight_sum").alias("weight_sum"), "submission_count", "comment_count",
    ).orderBy("date", "ticker", "model")
    (out.coalesce(files) if files else out).write.mode("overwrite").option("header", True).csv(path)


def csv(rows: DataFrame, path: str, order: Sequence[str] = (), files: int | None = 1) -> None:
    rows = rows.orderBy(*order) if order else rows
    (rows.coalesce(files) if files else rows).write.mode("overwrite").option("header", True).csv(path)


def json_lines(rows: DataFrame, folder: str, level: int = 10) -> list[str]:
    """zstd-compressed JSON lines, one file per partition, written in the tasks; the JVM can't write this codec here."""
    names = rows.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os
        import uuid

        import zstandard

        os.makedirs(folder, exist_ok=True)
        path, count = os.path.join(folder, f"part-{uuid.uuid4().hex}.jsonl.zst"), 0
        with open(path + ".tmp", "wb") as file, zstandard.ZstdCompressor(level=level).stream_writer(file) as stream:
            for frame in frames:
                for line in frame["line"]:
                    stream.write(line.encode() + b"\n")
                    count += 1
        os.replace(path + ".tmp", path) if count else os.remove(path + ".tmp")
        yield pd.DataFrame({"path": [path] if count else []})

    lines = rows.select(F.to_json(F.struct(*names)).alias("line"))
    return sorted(r[0] for r in lines.mapInPandas(run, "path string").collect())


def json_file(value, path: str) -> None:
    with open(path, "w", encoding="utf-8") as file:
        json.dump(value, file, indent=2, default=str)


_MARKS = ((0.001, "***"), (0.01, "**"), (0.05, "*"), (0.1, "."))


def stars(p: float | None) -> str:
    return next((m for limit, m in _MARKS if p is not None and p < limit), "")


def summary_rows(results) -> list[dict]:
    """One dictionary per regression: name, size, fit, and coefficient, error and p of each term."""
    out = []
    for r in results:
        row = {"name": r.spec.name, "target": r.spec.target, "effects": r.spec.effects, "cluster": r.spec.cluster, "n_obs": r.n_obs, "r2": r.r2, "r2_within": r.r2_within, "f_stat": r.f_stat, "f_pvalue": r.f_pvalue}
        for term in r.coefficients:
            row |= {f"{term}": r.coefficients[term], f"{term}_se": r.std_errors[term], f"{term}_p": r.p_values[term]}
        out.append(row)
    return out


def latex(header: Sequence[str], body: Sequence[Sequence[str]], caption: str = "", label: str = "") -> str:
    """A plain tabular; underscores are escaped."""
    safe = lambda s: str(s).replace("_", r"\_").replace("%", r"\%").replace("&", r"\&")
    lines = [r"\begin{table}[htbp]", r"\centering"] + ([rf"\caption{{{safe(caption)}}}"] if caption else []) + ([rf"\label{{{label}}}"] if label else [])
    lines += [rf"\begin{{tabular}}{{l{'r' * (len(header) - 1)}}}", r"\hline", " & ".join(map(safe, header)) + r" \\", r"\hline"]
    lines += [" & ".join(map(safe, row)) + r" \\" for row in body]
    return "\n".join([*lines, r"\hline", r"\end{tabular}", r"\end{table}"])


def garch_tables(result, path: str) -> None:
    """A fitted panel GARCH as ``path``.json (shared parameters, errors, fit), .csv (a row per stock) and .tex."""
    fit = {"loglik": result.loglik, "aic": result.aic, "bic": result.bic, "n_obs": result.n_obs, "n_params": result.n_params, "rounds": result.rounds, "converged": result.converged}
    stocks = result.stock_table()
    json_file({"global": result.global_params, "errors": result.global_errors, **fit, "stocks": stocks.to_dict("records")}, path + ".json")
    stocks.to_csv(path + ".csv", index=False)
    names = [c for c in stocks.columns if c not in ("ticker", "n_obs", "loglik")]
    number = lambda v: "" if v is None or v != v else f"{v:.4g}"
    body = [[c, number(stocks[c].mean()), number(stocks[c].median()), number(result.global_errors.get(c))] for c in names]
    body += [[k, number(float(v)), "", ""] for k, v in fit.items() if k != "converged"]
    with open(path + ".tex", "w", encoding="utf-8") as file:
        file.write(document(latex(["", "mean", "median", "std. error"], body, "Panel GARCH")))


def likelihood_ratio_tables(tests, path: str) -> None:
    """Likelihood-ratio tests as ``path``.json and .csv."""
    from dataclasses import asdict

    rows = [asdict(t) for t in tests]
    json_file(rows, path + ".json")
    pd.DataFrame(rows, columns=list(rows[0]) if rows else None).to_csv(path + ".csv", index=False)


def regression_latex(results, caption: str = "Panel regressions") -> str:
    """Coefficients with marks, errors in parentheses below, one column per specification; lag endings are left out."""
    import re

    terms = list(dict.fromkeys(re.sub(r"_lag\d+$", "", t) for r in results for t in r.coefficients))
    body = []
    for term in terms:
        upper, lower = [term], [""]
        for r in results:
            full = next((t for t in r.coefficients if re.sub(r"_lag\d+$", "", t) == term), None)
            upper.append(f"{r.coefficients[full]:.4f}{stars(r.p_values[full])}" if full else "")
            lower.append(f"({r.std_errors[full]:.4f})" if full else "")
        body += [upper, lower]
    body += [["Observations", *[f"{r.n_obs:,}" for r in results]], ["Within R2", *["" if r.r2_within is None else f"{r.r2_within:.4f}" for r in results]]]
    return latex(["", *[r.spec.name for r in results]], body, caption)


def document(*tables: str) -> str:
    return "\n".join([r"\documentclass{article}", r"\begin{document}", *tables, r"\end{document}"])


def average_fit(results) -> dict[str, float | None]:
    """Average R2, within R2 and number of observations over all results."""
    mean = lambda v: sum(v) / len(v) if v else None
    return {"r2": mean([r.r2 for r in results if r.r2 is not None]), "r2_within": mean([r.r2_within for r in results if r.r2_within is not None]), "n_obs": mean([r.n_obs for r in results])}


def correlation_latex(pairs, names: Sequence[str]) -> str:
    """Lower triangle of (a, b, corr) rows."""
    value = {(a, b): c for a, b, c in pairs} | {(b, a): c for a, b, c in pairs}
    body = [[n, *[f"{value[n, m]:.2f}" if j <= i and value.get((n, m)) is not None else "" for j, m in enumerate(names)]] for i, n in enumerate(names)]
    return latex(["", *[str(i + 1) for i in range(len(names))]], body, "Correlations")
