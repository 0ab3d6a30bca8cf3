"""Domains, constants and column sets shared by all operators."""

from __future__ import annotations

# --- fixed values: they must equal the workbench's own for equal results ---
STATUSES = ("pending", "correct", "modified", "uncertain", "skipped")
ANALYSIS_STATES = ("not_analyzed", "analyzed", "demo")
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".jfif", ".png", ".bmp", ".tif", ".tiff", ".webp", ".gif")
IMAGE_LEVEL_TYPES = ("iad", "classification", "classify", "cls")
OCR_FALLBACK_CLASS = "OCR文本"
EMPTY_PROJECT_CLASS = "未分类"
ANALYSIS_METADATA_KEYS = ("label_confidence", "neighbor_support", "_analysis_preview_sha256")
ANALYSIS_METADATA_PREFIX = "analysis_"
NEIGHBORS = 15
CLASSIFIER_WEIGHT = 0.7
NEIGHBOR_WEIGHT = 0.3
CENTROID_TEMPERATURE = 8.0
DISTANCE_OFFSET = 0.05
MAX_FOLDS = 5
MAX_HISTORY = 2048
QUEUE_LIMIT = 400
PLOT_LIMIT = 20_000
MAX_RESULT_PAGE = 200
RECENT_LIMIT = 8
RETENTION_SECONDS = 24 * 60 * 60
ACTIVE_STATES = ("uploading", "validating", "queued", "running")
BUSY_STATES = ("validating", "queued", "running")
MAX_PROJECT_BYTES = 128 * 1024 * 1024
MAX_CONTOUR_DEPTH = 32
FEATURE_WIDTH = 768
FINITE_CHECK_CHUNK = 1024 * 1024
PUBLIC_COLUMNS = (
    "id", "relative_path", "label", "suggested_label", "suspicion_score", "x", "y", "preview_url",
    "status", "original_label", "label_confidence", "neighbor_support", "analysis_state",
)
# --- end of fixed values ---
