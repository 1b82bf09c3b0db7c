"""Schemas of the engine's tables."""

HAND_POSE = "frame_number int, timestamp_ms double, left_hand_landmarks array<array<float>>, right_hand_landmarks array<array<float>>, left_confidence float, right_confidence float"
HEAD_POSE = "timestamp_ms double, position array<double>, quaternion array<double>, tracked boolean"
POSE_JOINTS = "frame_idx int, timestamp_ms double, joint_id smallint, joint_name string, x float, y float, z float, confidence float, provenance string, root_qw float, root_qx float, root_qy float, root_qz float, root_tracked boolean"
EPISODES = "`observation.state` array<float>, `observation.confidence` array<float>, action array<float>, timestamp float, frame_index bigint, episode_index bigint, index bigint, task_index bigint"
EVENTS = "id int, video_id string, type string, label string, start_time double, end_time double, duration_seconds double, property_tag string, description string"
SEGMENTS = "video_id string, start_time double, end_time double, task_label string, confidence double, description string, duration_seconds double"
VIDEOS = "id string, original_filename string, uploaded_at timestamp, operator_id string, property_tag string, duration_seconds double, status string"
PROFILE = "camera_model string, lens_model string, image_size array<int>, intrinsic_matrix array<array<double>>, distortion_coefficients array<double>, reprojection_error_pixels double"
EVAL_RUN = "ts double, dataset string, n bigint, n_samples bigint, mpjpe_mm double, pa_mpjpe_mm double, detection_rate double, per_joint_pa_mm map<string,double>, by_provenance_pa_mm map<string,double>"
