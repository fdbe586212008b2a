"""The queries of this package and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from offerrank.llm import digests, itq, licences, mixing, packing, simhash, spotsigs, suffixes, tokens, toxicity, tries, urls, whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pareto_mixing": mixing.op1,
        "op2_license_digests": licences.op2,
        "op3_toxicity_cnn": toxicity.op3,
        "op4_url_filter": urls.op4,
        "op5_simhash_golay": simhash.op5,
        "op6_best_fit_packing": packing.op6,
        "op7_suffix_dedup": suffixes.op7,
        "op8_spotsigs": spotsigs.op8,
        "op9_itq_hamming": itq.op9,
        "op10_token_counts": tokens.op10,
        "op11_digest_index": digests.op11,
        "op12_burst_tries": tries.op12,
        "op13_whitening": whitening.op13,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_pareto_mixing": mixing.SQL, "op2_license_digests": licences.sql(), "op4_url_filter": urls.SQL,
            "op11_digest_index": digests.SQL, "op12_burst_tries": tries.SQL}
