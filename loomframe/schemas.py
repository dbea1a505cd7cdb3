"""Schemas of the stored documents; nothing is inferred."""

from __future__ import annotations

METRICS = "run_id string, tag string, step bigint, value double, wall_time timestamp"
CONFIG = (
    "base_settings struct<output_base_dir:string,temp_dir:string,status_file:string,max_workers:int,base_frame_limit:int,"
    "max_retry_attempts:int,retry_skip_seconds:int,min_file_size:int,scene_diff_threshold:int>, "
    "videos array<struct<name:string,path:string,priority:int,categories:map<string,double>>>, "
    "format_config map<string,map<string,string>>, category_targets map<string,string>, category_paths map<string,string>"
)
STATUS = (
    "version string, started_at string, last_update string, workers int, status string, "
    "progress struct<total_videos:int,completed_videos:int,current_video_index:int,current_video_path:string>, "
    "category_stats map<string,struct<videos_processed:int,images_created:int,target:int,disk_usage_gb:double>>, "
    "video_checkpoints map<string,string>"
)
#: Fixed values. The fields of a saved state.
STATISTICS = (
    "step_current bigint, epoch_num int, step_max bigint, epoch_step_current bigint, epoch_step_total bigint, "
    "total_loss_value double, l1_loss_value double, ms_loss_value double, gradient_loss_value double, perceptual_loss_value double, "
    "l1_weight_current double, ms_weight_current double, gradient_weight_current double, perceptual_weight_current double, "
    "gradient_clip_val double, adaptive_mode string, adaptive_is_cooldown boolean, adaptive_cooldown_remaining int, "
    "adaptive_plateau_counter int, adaptive_lr_boost_available boolean, adaptive_perceptual_trend int, "
    "learning_rate_value double, lr_phase_name string, iteration_duration double, vram_usage_gb double, adam_momentum_avg double, "
    "eta_total_formatted string, eta_epoch_formatted string, quality_lr_value double, quality_ki_value double, "
    "quality_improvement_value double, quality_ki_to_gt_value double, quality_lr_to_gt_value double, validation_loss_value double, "
    "best_quality_ever double, layer_activity_map map<string,double>, training_active boolean, validation_running boolean, "
    "training_paused boolean, local_ip_address string, tensorboard_port int, last_update_time double"
)
SNAPSHOT = "step bigint, timestamp double, config map<string,double>"
EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
