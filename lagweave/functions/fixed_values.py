"""File formats, labels and lists that results depend on."""

SLOTS_PER_DAY = 96
SLOT_MINUTES = 15

# Column names of the wide-day CSV.
WIDE_ID = "SCATS Number"
WIDE_LOCATION = "Location"
WIDE_DATE = "Date"

# Names given by position to the nine columns of the site listing.
LISTING_COLUMNS = [
    "Site_Number",
    "Location_Description",
    "Site_Type",
    "Directory",
    "Map_Reference",
    "Unknown1",
    "Unknown2",
    "Unknown3",
    "Unknown4",
]
LISTING_PREAMBLE_LINES = 9

# Attribute column of the train/test file pair.
TWO_FILE_ATTRIBUTE = "Lane 1 Flow (Veh/5 Minutes)"

# Cell texts that a CSV reader of the pandas family takes as missing.
MISSING_TEXTS = [
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
]

WEEKDAY_LABELS = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]

# The six regression metrics, in report order, with their report titles.
METRIC_TITLES = {
    "explained_variance": "Explained Variance",
    "mape": "MAPE (%)",
    "mae": "MAE",
    "mse": "MSE",
    "rmse": "RMSE",
    "r2": "R²",
}

# Long display names of the metrics.
METRIC_NAMES = {
    "mape": "Mean Absolute Percentage Error (%)",
    "rmse": "Root Mean Squared Error",
    "r2": "R² Score",
    "mae": "Mean Absolute Error",
    "mse": "Mean Squared Error",
    "explained_variance": "Explained Variance Score",
}
HIGHER_IS_BETTER = ("r2", "explained_variance")

# Default region allowlist, in its own order.
REGION_SITES = (
    "2000", "2034", "2041", "2042", "2044", "2200", "2820", "2821", "2822", "2823", "2824", "2825",
    "2826", "2827", "2829", "2831", "2832", "2839", "2842", "2847", "3000", "3002", "3003", "3004",
    "3007", "3008", "3120", "3121", "3123", "3124", "3125", "3127", "3128", "3129", "3180", "3181",
    "3620", "3621", "3622", "3660", "3661", "3662", "3663", "3664", "3667", "3682", "3798", "3799",
    "3800", "3801", "3802", "3803", "3805", "3806", "3807", "3808", "3809", "3811", "3813", "3814",
    "3815", "3816", "3817", "3818", "3819", "3820", "3821", "3822", "3823", "3824", "3826", "3827",
    "3828", "3829", "3837", "3914", "3977", "4031", "4032", "4033", "4037", "4039", "4042", "4043",
    "4044", "4045", "4046", "4049", "4050", "4051", "4052", "4053", "4054", "4055", "4056", "4057",
    "4058", "4059", "4060", "4061", "4062", "4064", "4065", "4066", "4067", "4068", "4069", "4260",
    "4261", "4262", "4263", "4265", "4266", "4268", "4269", "4270", "4274", "4275", "4276", "4277",
    "4278", "4279", "4281", "4282", "4283", "4284", "4286", "4287", "4289", "4320", "4321", "4322",
    "4324", "4325", "4330", "4331", "4333", "4335", "4336", "4339", "7003",
)
