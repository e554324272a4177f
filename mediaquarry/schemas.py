"""Explicit schemas of the catalogue tables, and the JSON names of the record files."""

from __future__ import annotations

CAPTURE = "struct<wall_clock:timestamp_ntz,utc_offset_seconds:int>"
LOCATION = "struct<latitude:double,longitude:double,altitude_metres:double>"
CONFLICT = (
    "struct<field:string,preferred_origin:string,conflicting_origin:string,"
    "preferred_value:string,conflicting_value:string>"
)
METADATA = (
    "struct<kind:string,file_name:string,folder_path:string,"
    f"capture_time:{CAPTURE},capture_time_origin:string,"
    "camera_make:string,camera_model:string,lens_model:string,"
    "pixel_width:int,pixel_height:int,rotation_degrees:int,duration_ms:bigint,has_audio:boolean,"
    f"location:{LOCATION},rating:int,caption:string,tags:array<string>,"
    f"conflicts:array<{CONFLICT}>>"
)
IDENTITY = (
    "struct<absolute_path:string,volume_id:string,file_id:string,"
    "size_bytes:bigint,last_modified_ms:bigint>"
)
RECIPE = "struct<revision:int,operations:array<struct<kind:string,parameters:string>>>"
RECORD = (
    "id string, fingerprint struct<algorithm:string,digest:string>, "
    f"identity {IDENTITY}, original_storage string, managed_original_path string, "
    f"metadata {METADATA}, recipe {RECIPE}, "
    "derivative struct<source_media_id:string,recipe_revision:int,kind:string>, "
    "extras map<string,string>"
)

MEDIA = (
    "id string, record_json string, fingerprint_algorithm string, fingerprint_digest string, "
    "absolute_path string, volume_id string, file_id string, size_bytes bigint, "
    "last_modified_ms bigint, kind string, file_name string, file_extension string, "
    "folder_path string, capture_sort_key bigint, capture_has_offset int, camera_make string, "
    "camera_model string, pixel_width int, pixel_height int, duration_ms bigint, rating int, "
    "caption string, latitude double, longitude double"
)
LISTING = (
    "path string, file_name string, is_directory boolean, is_symlink boolean, "
    "size_bytes bigint, last_modified_ms bigint"
)
RECORD_TABLE = "record_file string, shard string, json string"
FILE = "path string, last_modified_ms bigint, length bigint, content binary, read_error string"
HASHED = "path string, digest string, read_error string"
EVENT = "root string, kind string, path string, rename_cookie bigint, observed_at timestamp_ntz"
WORK_REQUEST = (
    "id string, kind string, priority int, state string, coalescing_key string, payload string, "
    "attempts int, max_attempts int, created_at_ms bigint, not_before_ms bigint, "
    "last_error_code string"
)
CACHE_ENTRY = "cache_key string, size_bytes bigint, last_modified_ms bigint"
MANIFEST = "path string, size_bytes bigint, sha256 string"
CHECKPOINT = (
    "id string, message string, created_at_ms bigint, author_id string, "
    "application_version string, parent_id string"
)

# What the extraction job emits for one file; every interpretation is a Column expression.
TAG = "struct<dir:string,tag:int,type:int,count:bigint,text:string,nums:array<bigint>>"
PROPERTY = "struct<name:string,items:array<string>>"
BLOCK = (
    "struct<kind:string,ok:boolean,nums:array<bigint>,text:string,"
    f"tags:array<{TAG}>,props:array<{PROPERTY}>>"
)
RAW_BLOCKS = f"path string, damaged string, blocks array<{BLOCK}>"

# JSON member names of a stored record, in the order they are documented.
RECORD_JSON = (
    "schemaVersion int, id string, fingerprintAlgorithm string, fingerprintDigest string, "
    "identity struct<absolutePath:string,volumeId:string,fileId:string,sizeBytes:double,"
    "lastModified:string>, "
    "originalStorage string, managedOriginalPath string, "
    "metadata struct<kind:string,fileName:string,folderPath:string,"
    "captureTime:struct<wallClock:string,utcOffsetSeconds:int>,captureTimeOrigin:string,"
    "cameraMake:string,cameraModel:string,lensModel:string,pixelWidth:int,pixelHeight:int,"
    "rotationDegrees:int,durationMs:double,hasAudio:boolean,"
    "location:struct<latitude:double,longitude:double,altitudeMetres:double>,rating:int,"
    "caption:string,tags:array<string>,"
    "conflicts:array<struct<field:string,preferredOrigin:string,conflictingOrigin:string,"
    "preferredValue:string,conflictingValue:string>>>, "
    "recipe struct<revision:int,operations:array<struct<kind:string,parameters:string>>>, "
    "derivative struct<sourceMediaId:string,recipeRevision:int,kind:string>"
)
RECORD_JSON_KEYS = [
    "schemaVersion", "id", "fingerprintAlgorithm", "fingerprintDigest", "identity",
    "originalStorage", "managedOriginalPath", "metadata", "recipe", "derivative",
]
METADATA_JSON_KEYS = [
    "kind", "fileName", "folderPath", "captureTime", "captureTimeOrigin", "cameraMake",
    "cameraModel", "lensModel", "pixelWidth", "pixelHeight", "rotationDegrees", "durationMs",
    "hasAudio", "location", "rating", "caption", "tags", "conflicts",
]
RECIPE_JSON_KEYS = ["revision", "operations"]
RECORD_SCHEMA_VERSION = 2
