from tidelag.sources.results import read_skill, read_task_results, skill_to_json, write_skill, write_task_results
from tidelag.sources.series import bin_rows, fill_calendar, make_series, read_series_csv, read_tasks_json, require_paired

__all__ = [
    "bin_rows", "fill_calendar", "make_series", "read_series_csv", "read_skill", "read_task_results", "read_tasks_json", "require_paired",
    "skill_to_json", "write_skill", "write_task_results",
]
