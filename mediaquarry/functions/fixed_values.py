"""Names, lists and constants that results depend on, stated as they are defined."""

IMAGE_EXTENSIONS = [
    "jpg", "jpeg", "png", "tiff", "tif", "bmp", "gif", "webp", "heic", "heif", "avif",
    "cr2", "cr3", "nef", "arw", "raf", "dng", "orf", "rw2", "pef",
]
VIDEO_EXTENSIONS = [
    "mp4", "mov", "avi", "mkv", "m4v", "wmv", "flv", "webm", "3gp", "mts", "m2ts",
]
EMBEDDED_WRITE_EXTENSIONS = ["jpg", "jpeg", "png", "tif", "tiff"]
IMAGE_BRANDS = [
    "avif", "avis", "heic", "heix", "heim", "heis", "hevc", "heif", "mif1", "msf1", "miaf",
]

MEDIA_KINDS = ["unknown", "image", "video"]
METADATA_ORIGINS = ["unknown", "fileSystem", "embedded", "sidecar", "userEdit", "inferred"]
OPERATION_KINDS = ["crop", "rotate", "orientation", "trim"]
REQUEST_KINDS = [
    "unknown", "scanRoot", "reconcileRoot", "readMetadata", "generateThumbnail",
    "generatePreview", "extractVideoFrame", "writeMetadata", "export",
]
REQUEST_PRIORITIES = ["interactive", "userInitiated", "background", "opportunistic"]
REQUEST_STATES = ["pending", "running", "succeeded", "failed", "cancelled"]
TERMINAL_STATES = ["succeeded", "failed", "cancelled"]
ERROR_CODES = [
    "none", "cancelled", "notFound", "permissionDenied", "unsupportedMedia", "corruptData",
    "outOfSpace", "timeout", "conflict", "storageUnavailable", "interrupted", "internal",
]
RETRYABLE_ERRORS = ["timeout", "storageUnavailable", "interrupted"]

UNKNOWN_AUTHOR = "unknown"
DEFAULT_MAX_ATTEMPTS = 3
THUMBNAIL_TIERS = [128, 256, 512]
NO_CAPTURE_KEY = -9223372036854775808
RETENTION_SLACK = 16

DEBOUNCE_MS = 500
RENAME_TIMEOUT_MS = 2000
SWEEP_INTERVAL_MS = 15 * 60 * 1000
COMMIT_BATCH = 64
MAX_ARCHIVE_ENTRIES = 1_000_000

BM25_K1 = 1.2
BM25_B = 0.75
BM25_IDF_FLOOR = 1e-6

# EXIF / TIFF tag numbers and the movie epoch come from the public format documents.
TAG_MAKE, TAG_MODEL, TAG_ORIENTATION, TAG_DATE_TIME = 0x010F, 0x0110, 0x0112, 0x0132
TAG_WIDTH, TAG_HEIGHT, TAG_XMP = 0x0100, 0x0101, 0x02BC
TAG_EXIF_DIR, TAG_GPS_DIR = 0x8769, 0x8825
TAG_DATE_ORIGINAL, TAG_OFFSET, TAG_OFFSET_ORIGINAL = 0x9003, 0x9010, 0x9011
TAG_EXIF_WIDTH, TAG_EXIF_HEIGHT, TAG_LENS = 0xA002, 0xA003, 0xA434
GPS_LAT_REF, GPS_LAT, GPS_LON_REF, GPS_LON, GPS_ALT_REF, GPS_ALT = 1, 2, 3, 4, 5, 6
MAX_DIRECTORY_ENTRIES = 512
MAX_BOX_DEPTH = 8
MOVIE_EPOCH_SECONDS = 2082844800

LANGUAGE_BY_EXTENSION = {
    ".c": "C", ".cc": "C++", ".cpp": "C++", ".cxx": "C++", ".c++": "C++",
    ".h": "C/C++ Header", ".hh": "C/C++ Header", ".hpp": "C/C++ Header",
    ".hxx": "C/C++ Header", ".ipp": "C/C++ Header",
    ".qml": "QML", ".py": "Python", ".sh": "Shell", ".env": "Shell", ".ps1": "PowerShell",
    ".bat": "Batch", ".cmake": "CMake", ".yml": "YAML", ".yaml": "YAML", ".json": "JSON",
    ".toml": "TOML", ".ini": "INI", ".cfg": "INI", ".conf": "INI", ".txt": "Text",
    ".md": "Markdown", ".rst": "Text", ".xml": "XML", ".css": "CSS", ".js": "JavaScript",
    ".ts": "TypeScript", ".jsx": "JavaScript", ".tsx": "TypeScript", ".sql": "SQL",
    ".pro": "Qt Project", ".pri": "Qt Project", ".qmlproject": "Qt Project",
    ".qrc": "Qt Resource", ".svg": "SVG", ".properties": "Properties",
    ".gitignore": "Text", ".gitattributes": "Text",
}
LANGUAGE_BY_NAME = {
    "CMakeLists.txt": "CMake", "Dockerfile": "Docker", "Containerfile": "Docker",
    "Makefile": "Make", "README": "Text", "LICENSE": "Text", "NOTICE": "Text",
}
EXCLUDED_DIRS = [".git", ".cache", "__pycache__"]
EXCLUDED_ROOT_DIRS = ["build", "install"]
EXCLUDED_PREFIXES = ["docs/metrics/", "tools/metrics/"]
KEPT_DOT_FILES = [".gitignore", ".gitattributes"]
BLOCK_COMMENT_LANGUAGES = [
    "C++", "C", "C/C++ Header", "QML", "XML", "CSS", "JavaScript", "TypeScript",
    "Qt Resource", "SVG",
]
STAR_COMMENT_LANGUAGES = ["CSS", "JavaScript", "TypeScript"]
HASH_COMMENT_LANGUAGES = [
    "CMake", "Python", "Shell", "PowerShell", "Docker", "Make", "YAML", "TOML", "INI",
    "Properties",
]
MARKUP_COMMENT_LANGUAGES = ["Text", "Markdown"]
LARGEST_FILES = 15
