"""Fixed values of the analytics: thresholds, weights, prefixes and names."""

# Mixing transactions (CoinJoin)
MIN_INPUTS = 3
MIN_OUTPUTS = 3
MIN_EQUAL_OUTPUTS = 3

# The texts that say why a transaction counts as mixing or does not
MIXING_REASONS = ["%d inputs, %d outputs: too small", "largest equal-value group is %d, need %d", "%d outputs of %.8f BTC across %d inputs"]

# Change scoring
WEIGHT_RAGGED = 0.40
WEIGHT_FRESH = 0.30
WEIGHT_SCRIPT = 0.15
WEIGHT_SPENT_SOON = 0.35
SPENT_SOON_MICROS = 48 * 3600 * 1_000_000
MIN_MARGIN = 0.30
ROUND_UNIT = 100_000

# Change merges
MIN_MERGE_CONFIDENCE = 0.40
MERGE_BUDGET = 60
MERGE_ANYWAY_CONFIDENCE = 0.70

# Script type by address prefix
SCRIPT_PREFIXES = [("bc1q", "v0_p2wpkh"), ("3", "p2sh"), ("1", "p2pkh")]
UNKNOWN_SCRIPT = "unknown"

# Peeling chains
MIN_CHAIN_LENGTH = 4
MIN_CARRY_SHARE = 0.75
LAUNDERING_MAX_MEDIAN_PEEL = 0.15
LAUNDERING_MAX_SPREAD = 0.20
LAUNDERING_MIN_HOPS = 8

# attribution
SIGNIFICANCE = 0.01
MIN_TRANSACTIONS = 5

# scoring
SCORING_MIN_TRANSACTIONS = 3
FOREST_TREES = 300
FOREST_DEPTH = 8
FOREST_LEAF = 2
SEED = 42
FOLDS = 5
STABILITY_SEEDS = list(range(8))
NULL_SEEDS = list(range(3))
ISOLATION_TREES = 300
ISOLATION_SAMPLE = 256
CONTAMINATION = 0.08
TOP_FACTORS = 5
RISK_BANDS = [(0.80, "Critical"), (0.50, "High"), (0.25, "Elevated")]
LOWEST_BAND = "Low"

# The lines of the stage report (stage, tables, summary)
STAGE_REPORT = [
    ("Ingest", "tx_l1 + net_l2", "%s transactions, %s network sightings"),
    ("Clustering", "clusters + tx_flags", "%s clusters, %s CoinJoins filtered"),
    ("Graph", "entities + chains", "%s entities, %s chains recovered"),
    ("Fusion", "leads", "%s significant attributions of %s scored"),
    ("Models", "scores", "%s entities scored, %s flagged as anomalous"),
]

# Features by group, in order
FEATURE_GROUPS = {
    "volume": ["n_transactions", "n_addresses", "tx_per_active_day", "total_out", "n_received"],
    "value": ["mean_value", "median_value", "value_spread", "mean_fee", "fee_spread"],
    "structure": ["mean_inputs", "mean_outputs", "max_inputs", "n_script_types", "fan_out", "fan_in"],
    "timing": ["mean_hour", "nocturnal_share", "hour_coverage"],
    "laundering": ["chain_hops", "chain_median_peel", "chain_laundering_like", "coinjoin_share"],
    "network": ["has_attribution", "first_relay_share", "n_countries", "n_asns", "top_asn_share"],
}
FEATURES = [f for names in FEATURE_GROUPS.values() for f in names]
