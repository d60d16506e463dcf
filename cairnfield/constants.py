"""Fixed values that results depend on. They differ by operator on purpose."""

# fixed values: earth figures
EARTH_RADIUS_M = 6378137.0
METRIC_RADIUS_M = 6371008.8
TILE_CIRCUMFERENCE_M = 40075016.68557849
CAPTURE_CIRCUMFERENCE_M = 40075016.686
HALF_WORLD_M = 20037508.342789244
MAX_MERCATOR_LAT = 85.05112878
EXTENT_MAX_LAT = 85.051129
CAPTURE_SIN_LIMIT = 0.9999

# fixed values: tiles and imagery planning
TILE_SIZE = 256
TILE_BUFFER_M = 20.0
MAX_TILE_ZOOM = 21
DETAIL_ZOOM = 21
DETAIL_TILES_PER_SIDE = 8
DETAIL_CELL_PX = 2048
DETAIL_CELL_LIMIT = 40
OVERVIEW_MAX_SIDE = 4096
CAPTURE_MAX_SIDE = 8192
CAPTURE_MAX_TILES = 256
CAPTURE_MAX_ZOOM = 16
EXPORT_IMAGE_PX = 4000
MAX_WORKING_SIDE = 7000
STORAGE_SAFETY = 1.5

# fixed values: control-point fit
MIN_SPREAD_RATIO = 0.08
PIVOT_FLOOR = 1e-12
AFFINE_DET_FLOOR = 1e-9
SCALE_MIN = 0.005
SCALE_MAX = 200.0
OUTLIER_MIN_M = 25.0
OUTLIER_FACTOR = 2.2
LOOSE_RMS_M = 60.0

# fixed values: colours and review
CHIP_MERGE_DISTANCE = 40.0
DIVERSE_DISTANCE = 48.0
DIVERSE_COUNT = 10
CLUSTER_DISTANCE = 34.0
# fixed values: colour names, in order: name, highest lightness and saturation (exclusive), least
# lightness (exclusive), hue ranges [from, to)
COLOR_NAMES = [
    ("Black", 0.16, None, None, [(0, 361)]),
    ("White", None, 0.16, 0.82, [(0, 361)]),
    ("Gray", None, 0.16, None, [(0, 361)]),
    ("Brown", 0.42, 0.65, None, [(10, 45), (340, 361)]),
    ("Red", None, None, None, [(0, 12), (345, 361)]),
    ("Brown", 0.35, None, None, [(0, 42)]),
    ("Orange", None, None, None, [(0, 42)]),
    ("Yellow", None, None, None, [(0, 68)]),
    ("Green", None, None, None, [(0, 160)]),
    ("Teal", None, None, None, [(0, 195)]),
    ("Blue", None, None, None, [(0, 250)]),
    ("Purple", None, None, None, [(0, 290)]),
    ("Pink", None, None, None, [(0, 361)]),
]
CONFIDENCE_MEDIUM = 0.5
CONFIDENCE_HIGH = 0.75

# fixed values: request pacing
BUDGET_WINDOW_S = 3600
STARTS_PER_SECOND = 5
MAX_ATTEMPTS = 6
BASE_DELAY_MS = 1000
MAX_DELAY_MS = 60000

# fixed values: feature defaults
DEFAULT_COLORS = {"trail": "#D9480F", "area": "#3A7D44", "poi": "#1F6FB2"}
DEFAULT_DOCUMENT_NAME = "Park map"

# fixed values: point-of-interest kind, GPX symbol, KML icon
POI_SYMBOLS = [
    ("Trailhead", "Trailhead", "hiker"),
    ("Parking", "Parking Area", "parking_lot"),
    ("Restroom", "Restroom", "toilets"),
    ("Viewpoint", "Scenic Area", "camera"),
    ("Campsite", "Campground", "campground"),
    ("Water", "Drinking Water", "placemark_circle"),
    ("Information", "Information", "info-i"),
    ("Junction", "Crossing", "placemark_square"),
    ("Waypoint", "Waypoint", "placemark_circle"),
]
KML_ICON_PREFIX = "https://maps.google.com/mapfiles/kml/shapes/"

# fixed values: looks of exported features
KML_LINE_WIDTH = "4"
KML_ICON_SCALE = "1.1"
KML_FILL_ALPHA = "55"
KML_OVERLAY_COLOR = "ccffffff"
KML_FOLDERS = ["Trails", "Areas", "Points of interest"]
