"""The subpackage's queries and their SQL."""

from __future__ import annotations

from postmill.llm import decontaminate, infilling, licenses, rules, sharding
from postmill.llm.decontaminate import op9_winnowing_decontamination
from postmill.llm.infilling import op11_fill_in_middle
from postmill.llm.jaccard import op10_ngram_jaccard_join
from postmill.llm.licenses import op4_license_scan
from postmill.llm.packing import op6_best_fit_packing
from postmill.llm.periodic import op13_periodic_runs
from postmill.llm.pii import op5_pii
from postmill.llm.quality import op1_quality_classifier
from postmill.llm.rules import op2_quality_rules
from postmill.llm.secrets import op8_secret_scan
from postmill.llm.sharding import op7_sharding
from postmill.llm.simhash import op12_simhash_near_dedup
from postmill.llm.toxicity import op3_toxicity

QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_classifier,
        op2_quality_rules,
        op3_toxicity,
        op4_license_scan,
        op5_pii,
        op6_best_fit_packing,
        op7_sharding,
        op8_secret_scan,
        op9_winnowing_decontamination,
        op10_ngram_jaccard_join,
        op11_fill_in_middle,
        op12_simhash_near_dedup,
        op13_periodic_runs,
    )
}


def sql() -> dict[str, str]:
    return {
        "op2_quality_rules": rules.ORACLE,
        "op4_license_scan": licenses.oracle(),
        "op7_sharding": sharding.oracle(),
        "op9_winnowing_decontamination": decontaminate.ORACLE,
        "op11_fill_in_middle": infilling.ORACLE,
    }
