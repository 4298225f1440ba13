"""DataFrame to DataFrame operators over bars and news."""
