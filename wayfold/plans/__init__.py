"""Plans of the ride analytics engine."""
