"""Every training-data query with Python workers, where workers cannot import the package."""

from ..test_foreign_folder import run_elsewhere


def test_operators_run_from_another_folder(tmp_path):
    run_elsewhere(tmp_path, ["op1_best_fit_packing", "op2_one_bit_neighbours", "op5_language_id", "op6_fuzzy_lines", "op7_tool_calls",
                             "op8_simhash_near_dedup", "op11_ptolemaic_clusters", "op12_prefix_trie", "pipeline"])
