"""Fixed values of the export format and of the catalog tables.

Nothing here is computed: these are the word lists, formats and constants that
results depend on, kept together so that they can be read and checked.
"""

# --- fixed values: folder layout of an export -------------------------------
EXPORT_SUBFOLDER = "Takeout/Google Photos"
ALBUM_METADATA_NAME = "metadata.json"
EXPORT_PAGE_NAME = "archive_browser.html"
YEAR_ALBUM_PATTERN = r"(?i)^Photos from (\d{4})"
YEAR_ALBUM_TITLE = "Photos from "
YEAR_MIN, YEAR_MAX = 1900, 2200

# --- fixed values: files that are never media --------------------------------
SYSTEM_FILES = ["thumbs.db", "desktop.ini", ".ds_store", "icon\r"]
EXPORT_FILES = [
    "print-subscriptions.json",
    "shared_album_comments.json",
    "user-generated-memory-titles.json",
    "archive_browser.html",
]
TEMPORARY_SUFFIXES = [".tmp", ".temp", ".cache", ".bak", ".swp"]

# --- fixed values: extensions -------------------------------------------------
# Extensions that make the suffix of a media name count as a real one.
MEDIA_EXTENSIONS = [
    ".jpg", ".jpeg", ".png", ".gif", ".webp", ".heic", ".svg",
    ".mp4", ".m4v", ".mov", ".mpg", ".mpeg", ".3gp", ".avi", ".mkv", ".webm",
]
# Extensions recognised inside a sidecar name. The two lists differ on purpose.
SIDECAR_EXTENSIONS = [
    "jpg", "jpeg", "jpe", "png", "gif", "webp", "heic", "heif", "bmp", "tif", "tiff",
    "svg", "webm", "mp4", "mov", "avi", "m4v", "3gp", "jfif", "dng", "cr2", "cr3",
    "arw", "nef", "raf", "orf",
]
# One-character extensions and what they stand for.
ONE_CHAR_EXTENSIONS = {
    "p": "png", "g": "gif", "h": "heic", "a": "avi", "s": "svg", "3": "3gp", "j": "jpg",
}
LIVE_IMAGE_SUFFIXES = [".heic", ".jpg", ".jpeg"]
LIVE_VIDEO_SUFFIX = ".mov"

# --- fixed values: name patterns ----------------------------------------------
SIDECAR_JSON_TAIL = r"(?i)\.json\s*\z"
SIDECAR_NUMBER_TAIL = r"\((\p{Nd}+)\)\s*\z"
SIDECAR_SUPPLEMENT_TAIL = (
    r"(?i)\.(?:s|supp(?:lemen(?:t(?:al)?)?)?)(?:-(?:meta(?:data)?)?)?-?\s*\z"
)
EDITED_MARK = "-edited"
EDITED_MARKS_LOCALIZED = ["-edited", "-bearbeitet", "-modifié", "-redigert", "-bewerkt"]

# --- fixed values: archives -----------------------------------------------------
ARCHIVE_FORMATS = {
    ".zip": "zip", ".tar": "tar", ".tar.gz": "tar.gz", ".tgz": "tgz",
    ".tar.bz2": "tar.bz2", ".tbz2": "tbz2",
}
INVALID_MEMBER_CHARS = r'[<>:"|?*]'
RESERVED_DEVICE_NAMES = [
    "CON", "PRN", "AUX", "NUL",
    "COM1", "COM2", "COM3", "COM4", "COM5", "COM6", "COM7", "COM8", "COM9",
    "LPT1", "LPT2", "LPT3", "LPT4", "LPT5", "LPT6", "LPT7", "LPT8", "LPT9",
]

# --- fixed values: content ------------------------------------------------------
FINGERPRINT_HEAD_BYTES = 65536
FINGERPRINT_TAIL_BYTES = 65536
UNKNOWN_MIME = "application/octet-stream"
# (mime type, byte offset, hex of the bytes found there); the first hit wins.
ANYWHERE = -1
MAGIC_BYTES = [
    ("image/jpeg", 0, "FFD8FF"),
    ("image/png", 0, "89504E47"),
    ("image/gif", 0, "474946"),
    ("image/webp", 8, "57454250"),
    ("image/tiff", 0, "49492A00"),
    ("image/tiff", 0, "4D4D002A"),
    ("image/bmp", 0, "424D"),
    ("image/heic", 4, "6674797068656963"),
    ("image/heic", 4, "6674797068656978"),
    ("image/heic", 4, "667479706D696631"),
    ("image/avif", 4, "6674797061766966"),
    ("video/3gpp", 4, "66747970336770"),
    ("video/x-m4v", 4, "667479704D3456"),
    ("video/quicktime", 4, "667479707174"),
    ("video/mp4", 4, "6674797069736F"),
    ("video/mp4", 4, "667479706D7034"),
    ("video/mp4", 4, "6674797061766331"),
    ("video/mp4", 4, "6674797064617368"),
    ("video/mp4", 4, "667479704D534E56"),
    ("video/webm", ANYWHERE, "7765626D"),
    ("video/x-matroska", ANYWHERE, "6D6174726F736B61"),
    ("video/x-msvideo", 8, "41564920"),
    ("video/mpeg", 0, "000001BA"),
    ("video/mpeg", 0, "000001B3"),
    ("video/x-ms-wmv", 0, "3026B2758E66CF11A6D9"),
    ("video/x-flv", 0, "464C5601"),
]
MAGIC_HEAD_BYTES = 4096
# What must stand at the very beginning besides.
MAGIC_CONTAINERS = {
    "image/webp": "52494646",
    "video/x-msvideo": "52494646",
    "video/webm": "1A45DFA3",
    "video/x-matroska": "1A45DFA3",
}

# --- fixed values: identifiers --------------------------------------------------
UUID_DNS_NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"

# --- fixed values: times --------------------------------------------------------
CAMERA_DEFAULT_TIMES = ["1970-01-01", "1980-01-01", "2000-01-01", "2001-01-01"]
CAMERA_DEFAULT_WINDOW_SECONDS = 60
EARLIEST_CAMERA_YEAR = 1990
MAX_FUTURE_DAYS = 365
EPOCH_SECONDS_MIN, EPOCH_SECONDS_MAX = -62135596800, 253402300799
# Patterns tried in this order against a file name: date and, where present, time.
NAME_TIME_PATTERNS = [
    r"(?:IMG|VID)_\d{8}_\d{6}",
    r"\d{8}_\d{6}",
    r"\d{4}-\d{2}-\d{2}\s+\d{2}\.\d{2}\.\d{2}",
    r"\d{4}-\d{2}-\d{2}",
]

# --- fixed values: tag names requested from the tag reader ----------------------
TAG_NAMES = [
    "DateTimeOriginal", "CreateDate", "GPSLatitude", "GPSLongitude", "GPSAltitude",
    "Make", "Model", "LensMake", "LensModel", "FocalLength", "FNumber", "ExposureTime",
    "ISO", "Orientation", "Flash", "WhiteBalance", "ImageWidth", "ImageHeight",
]

# --- fixed values: enumerations of the stored tables ----------------------------
RUN_STATUSES = ["running", "completed", "failed"]
ALBUM_STATUSES = ["present", "error", "missing"]
MEDIA_STATUSES = ["present", "missing", "error", "inconsistent"]
ERROR_TYPES = ["media_file", "json_sidecar", "album_metadata"]
ERROR_CATEGORIES = [
    "permission_denied", "corrupted", "io_error", "parse_error", "unsupported_format",
]
# Kind of failure -> internal category.
ERROR_KINDS = {
    "PermissionDeniedError": "permission",
    "CorruptedFileError": "corrupted",
    "IOError": "io",
    "ParseError": "parse",
    "UnsupportedFormatError": "unsupported",
    "ToolNotFoundError": "tool_missing",
    "PermissionError": "permission",
    "OSError": "io",
    "ValueError": "parse",
    "KeyError": "parse",
    "AttributeError": "parse",
}
UNKNOWN_ERROR_KIND = "unknown"
# Internal category -> stored category.
STORED_CATEGORIES = {
    "permission": "permission_denied",
    "corrupted": "corrupted",
    "io": "io_error",
    "parse": "parse_error",
    "unsupported": "unsupported_format",
    "tool_missing": "unsupported_format",
    "unknown": "parse_error",
}
RUN_COUNTERS = [
    "total_files_discovered", "media_files_discovered", "metadata_files_discovered",
    "media_files_with_metadata", "media_files_processed", "metadata_files_processed",
    "media_new_files", "media_unchanged_files", "media_changed_files", "missing_files",
    "media_error_files", "inconsistent_files", "albums_total",
]

# --- fixed values: log lines ----------------------------------------------------
LOG_LEVELS = ["info", "warning", "error", "debug"]
# (event, words that must all occur in the lower-cased line); the first hit wins.
LOG_EVENTS = [
    ("scan_complete", ["scanning complete"]),
    ("albums_discovered", ["albums discovered"]),
    ("files_discovered", ["files discovered"]),
    ("phase_1_happy_path", ["phase 1", "happy path"]),
    ("phase_2_numbered_files", ["phase 2", "numbered files"]),
    ("phase_3_edited_files", ["phase 3", "edited files"]),
    ("phase_4_unmatched", ["phase 4", "unmatched"]),
    ("match_rate", ["match rate"]),
    ("multiple_sidecars_warning", ["multiple sidecars for media file"]),
]

# --- fixed values: texts of tag values and log lines ------------------------------
DEGREES_PATTERN = r"""^(\d+) deg (\d+)' ([\d.]+)" ([NSEW])"""
ALTITUDE_PATTERN = r"^([\d.]+)"
LOG_MATCHES_PATTERN = r"(\d+)\s+matches?"
LOG_UNMATCHED_PATTERN = r"(\d+)\s+media files?.*?(\d+)\s+sidecars?"
LOG_RATE_PATTERN = r"(\d+\.?\d*)%"
