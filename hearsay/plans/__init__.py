"""plans of the review-analytics engine."""
