"""Row types of the data model. What is unknown is null."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {"double": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType(), "int": T.IntegerType(), "long": T.LongType(), "binary": T.BinaryType()}


def _of(fields: str, **more: T.DataType) -> T.StructType:
    """A struct of `name type` fields, then of the named types."""
    plain = [T.StructField(name, _TYPES[kind]) for name, kind in (f.split() for f in fields.split(","))]
    return T.StructType([*plain, *(T.StructField(name, kind) for name, kind in more.items())])


_POINTS = T.ArrayType(_of("x double, y double"))
_DOUBLES, _STRINGS = T.ArrayType(T.DoubleType()), T.ArrayType(T.StringType())

GPS = _of("latitude double, longitude double, altitude_m double")
POSE = _of("yaw_deg double, pitch_deg double, roll_deg double")
CAMERA = _of(
    "focal_length_mm double, equivalent_focal_length_mm double, sensor_width_mm double, sensor_height_mm double, "
    "calibrated_focal_length_px double, calibrated_optical_center_x_px double, calibrated_optical_center_y_px double, calibrated boolean"
)
MISSION = _of("flight_id string, waypoint_id string, facade_hint string")
CATALOG = _of(
    "image_id string, file_path string, timestamp_utc string, drone_model string, camera_model string, width int, height int",
    gps=GPS, drone_pose=POSE, gimbal_pose=POSE, camera=CAMERA, mission=MISSION,
)
PAIRS = _of("image_a string, image_b string, gps_distance_m double, view_angle_delta_deg double, reason string")
MATCHES = _of("image_a string, image_b string, num_matches int", keypoints_a=_POINTS, keypoints_b=_POINTS, confidence=_DOUBLES)
GEOMETRY = _of("image_a string, image_b string, status string, num_matches int, num_inliers int, inlier_ratio double, median_reprojection_error_px double", homography=_DOUBLES, inlier_mask=T.ArrayType(T.BooleanType()))
PERIODS = _of("image_id string, period_px double, confidence double, num_candidate_pairs int, num_inlier_pairs int", harmonic_scores=T.MapType(T.IntegerType(), T.IntegerType()))
SENSOR_FRAMES = _of("stream_id string, frame_id long, timestamp_sec double, image_encoding string, image_width int, image_height int", gps=GPS, pose=POSE)
TS_PACKETS = _of("stream_id string, chunk_id long, sequence_id long, timestamp_sec double, data binary")
JOB_EVENTS = _of("archive_id long, kind string, worker_id string, reason string, started_immediately boolean, queue_position long, stage string, progress string, error_message string, success boolean, epoch_ms long")
ASSIGNMENT = _of(
    "Topic string, Key string, DRONE string, Version int, ContractId string, CustomerName string, RequestNo string, BuildingName string, Address string, ContractStart string, ContractEnd string",
    Buildings=_STRINGS, Directions=_STRINGS, FaceMap=T.ArrayType(_of("DongNo string, Direction string, Face string")),
)
SITES = T.StructType([T.StructField("companies", T.ArrayType(_of("name string", buildings=_STRINGS)))])

#: Failure codes of pair geometry, in the order in which the gates apply.
FAILURES = ("LOW_MATCH", "LOW_INLIER", "HIGH_REPROJECTION_ERROR", "DEGENERATE_HOMOGRAPHY", "MATCH_TIMEOUT", "MATCH_FAILED", "POSE_INCONSISTENT", "FLOOR_COUNT_MISMATCH")
