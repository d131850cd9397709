"""Settings and fixed values shared by every operator."""

from __future__ import annotations

from dataclasses import dataclass

# --- Fixed values: must equal the surveyed project's behaviour ------------
# Strings the pandas 1.3 CSV reader turns into nulls by default.
NA_MARKERS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "n/a", "nan",
    "null",
)
HELD_OUT_SHARE = 0.2       # stratified / random split
MAX_TOKENS = 250           # per encoded example, both markers included
TRAIN_BATCH = 8
INFER_BATCH = 128
MASK_RATE = 0.15           # masked-LM selection share
MASK_SPLIT = (80, 10, 10)  # selected: masked / random token / unchanged (%)
CORPUS_EPOCHS = 15
SEED = 42
LOG_FLOOR = 1e-6           # probability floor for the loss
EVERY_N_BATCHES = 10

# Special token ids of our own vocabulary (ours, not the project's).
BOS_ID, PAD_ID, EOS_ID, UNK_ID = 0, 1, 2, 3
FIRST_TOKEN_ID = 4

# Columns of the annotated message table (fixture schema).
ANNOTATED_SCHEMA = (
    "`Index` INT, `Original Text` STRING, `Translation` STRING, "
    "`Intent1_Cleaned` STRING, `Intent2` STRING, `Other` STRING, "
    "`Quality Check` STRING, `Intent1_Original` STRING"
)
LABEL_MAP_SCHEMA = "intent STRING, corresponding_label INT"
SPLIT_SCHEMA = "doc_id BIGINT, text STRING, label INT"

# Token pattern: maximal runs of letters or digits, lower-cased first.
TOKEN_SPLIT = r"[^\p{L}\p{N}]+"   # separators (Spark ML RegexTokenizer, gaps=True)
TOKEN_RUN = r"[\p{L}\p{N}]+"      # tokens (regexp_extract_all)


@dataclass(frozen=True)
class TriageConfig:
    """Typed run settings (replaces a command line with string flags)."""

    seed: int = SEED
    test_share: float = HELD_OUT_SHARE
    train_batch: int = TRAIN_BATCH
    min_df: int = 1
    max_vocab: int | None = None     # every token
    smoothing: float = 1.0
    background_mu: float = 1000.0
    on_singleton: str = "error"   # or "train"
    val_share: float | None = None   # a separate validation part (None: validate on the test part)
    # Weight matrix shipped with the tasks for in-batch scoring (join path above).
    lookup_bytes: int = 64 << 20
