"""Values that decide whether results agree with an existing matrix."""

# Results are only comparable when these stay as they are.
EXIST_FRACTION = 0.05          # a pair exists when inter > 0.05 * (n_i^2 + n_j^2)
QUANT_LEVELS = 255             # 8-bit cells, value = q / 255
QUANT_STEP = 1.0 / 255.0       # tolerance of the full-row and top-k checks
SELF_TOLERANCE = 1e-6          # tolerance of the self-pair check
DEFAULT_SEED = 42
DEFAULT_KS = (10, 20, 50, 100, 1000, 10000)
DEFAULT_TOP = 10
REPORT_HEAD = 20
KMER_LENGTH = 21
SKETCH_DIM = 2048
PRINTED_PREAMBLE = ("Processing row_file:", "Query completed")
ABSENT = -1                    # written for the value columns of an absent pair

# Size bounds of everything that is handed to all executors.
MAX_BROADCAST_BYTES = 64 << 20     # query vectors kept in memory by every task
MAX_TILE_BYTES = 256 << 20         # the slab of vectors that a task holds while others stream past it
HOT_GROUP_ROWS = 100_000           # rows of one key per task before it is salted
MAX_HOT_KEYS = 10_000              # keys treated one by one, by their share of all rows
PAIR_GROUP_ROWS = 2_000            # rows of one key per task where pairs of them are formed
MAX_LIST_ROWS = 1_000_000           # rows of one level of a list that are ranked together
