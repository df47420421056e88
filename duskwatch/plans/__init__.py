"""Query surface over alerts: filters, pages, statistics and reports."""
