"""All log types in one job."""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.parsers.host import (
    parse_file_action,
    parse_firewall,
    parse_panel_access,
    parse_panel_login,
    parse_ssh,
    parse_syslog,
)
from tidewatch.parsers.mail import parse_mail_flow, parse_mail_login
from tidewatch.parsers.stateful import parse_sar, parse_waf
from tidewatch.parsers.web import parse_http_access, parse_http_error, parse_wp_error

PARSERS = {
    "apache_access": partial(parse_http_access, source="APACHE_ACCESS"),
    "nginx_access": partial(parse_http_access, source="NGINX_ACCESS"),
    "apache_error": parse_http_error,
    "exim_mainlog": parse_mail_flow,
    "maillog": parse_mail_login,
    "lfd": parse_firewall,
    "modsec": parse_waf,
    "system": parse_syslog,
    "secure": parse_ssh,
    "cpanel_access": parse_panel_access,
    "panel_logs": parse_panel_login,
    "wp_error_log": parse_wp_error,
    "sar": parse_sar,
    "filemanager": parse_file_action,
}


def parse_all(lines: DataFrame, ref_now=None, log_types: list[str] | None = None, lenient: bool = False) -> DataFrame:
    """Events of all lines by their `log_type`; lines of other types are left to the rejects of `resolve_log_type`.

    Name the log types present in the input, and no branch is planned for the others. Each branch reads the lines of its type; over a table
    from `sources.lines.by_log_type` that is its own folder, so all branches together read the lines once.
    """
    wanted = list(PARSERS) if log_types is None else log_types
    parts = [PARSERS[t](lines.filter(F.col("log_type") == t), ref_now, lenient=lenient) for t in wanted]
    return reduce(DataFrame.unionByName, parts)
